"""Scalar functions over paths, lines and words."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_estimate(n_bytes: Column, per_token: int = 4) -> Column:
    """Tokens of so many bytes, rounded up; with a divisor of 0 the bytes themselves."""
    return F.ceil(n_bytes / per_token).cast("long") if per_token else n_bytes.cast("long")


def size_class(n_bytes: Column, small: int = 200_000, medium: int = 1_500_000) -> Column:
    return F.when(n_bytes < small, "small").when(n_bytes < medium, "medium").otherwise("large")


def any_cell_contains(cells: Sequence[Column], query: str) -> Column:
    """Some cell holds the query, in whatever case."""
    return reduce(or_, [F.coalesce(F.contains(F.lower(c.cast("string")), F.lit(query.lower())), F.lit(False)) for c in cells])


def path_matches(path: Column, pattern: str) -> Column:
    """Some of the alternatives between bars is part of the path, in whatever case; no alternatives match all."""
    parts = [p.strip().lower() for p in pattern.split("|") if p.strip()]
    return reduce(or_, [F.contains(F.lower(path), F.lit(p)) for p in parts]) if parts else F.lit(True)


def query_words(text: Column) -> Column:
    """Distinct words (letters, digits, _) of two bytes or more, in small letters."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    return F.array_distinct(F.filter(words, lambda w: F.octet_length(w) >= 2))


def keyword_score(haystack: Column, words: Sequence[str]) -> Column:
    """Share of the words that are part of the text, in small letters; 0 without words."""
    if not words:
        return F.lit(0.0)
    hits = reduce(lambda a, b: a + b, [F.contains(F.lower(haystack), F.lit(w.lower())).cast("int") for w in words])
    return F.coalesce(hits, F.lit(0)) / float(len(words))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 where sizes differ, a side is empty or null, or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def cosine_to(a: Column, vector: Sequence[float]) -> Column:
    """``cosine`` with a vector that is known: its norm is taken once, and the sums are plain expressions."""
    v = [float(x) for x in vector]
    norm = math.sqrt(sum(x * x for x in v))
    if not v or not norm:
        return F.lit(0.0)
    cells = [F.get(a, F.lit(i)).cast("double") for i in range(len(v))]
    dot, own = reduce(add, [c * x for c, x in zip(cells, v, strict=True)]), F.sqrt(reduce(add, [c * c for c in cells]))
    return F.when((F.size(a) == len(v)) & (own > 0), dot / (own * norm)).otherwise(0.0)


def crunch(text: Column) -> Column:
    """Each line without blanks at its end, runs of line ends as one, nothing blank at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t\r]+(?=\n)", ""), r"\n+", "\n"), r"[ \t\r\n]+$", "")


def path_score(path: Column, terms: Sequence[str]) -> Column:
    """30 for each term in the file's name, 10 for each other term in the path."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    each = [F.when(F.contains(name, F.lit(t.lower())), 30).when(F.contains(F.lower(path), F.lit(t.lower())), 10).otherwise(0) for t in terms]
    return reduce(lambda a, b: a + b, each, F.lit(0))


#: What a path's parts add to its importance, and the files that open a program, serve requests or describe a package.
IMPORTANCE = {"entry": 120, "service": 90, "src": 30, "core": 25, "manifest": 60, "markdown": 10, "config": 5, "test": -1000, "generated": -30, "depth": -5}
ENTRY_FILES = "__init__.py app.ts app.tsx build.rs cli.js cli.ts index.ts index.tsx lib.rs main.go main.py main.rs main.ts main.tsx mod.rs".split()
SERVICE_FILES = (
    "api.rs api.ts app.py app.rs controller.rs controller.ts handler.rs handler.ts handlers.rs router.rs router.ts routes.rs routes.ts server.py server.rs server.ts service.rs service.ts".split()
)
MANIFEST_FILES = ["cargo.toml", "package.json"]


def importance(path: Column) -> Column:
    """Sum of IMPORTANCE over what the path shows: kind of file, folders on the way (between slashes), depth beyond six."""
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    points = lambda cond, kind: F.when(cond, IMPORTANCE[kind]).otherwise(0)
    depth = F.length(low) - F.length(F.replace(low, F.lit("/"), F.lit("")))
    return (
        points(low.rlike(r"/tests?/|/test_") | name.rlike(r"\.spec\.|[._]test\.|^test_"), "test")
        + points(name.isin(ENTRY_FILES), "entry")
        + points(name.isin(SERVICE_FILES), "service")
        + F.regexp_count(low, F.lit("/src/")) * IMPORTANCE["src"]
        + points(low.rlike(r"/(core|lib|common|shared)/"), "core")
        + points(reduce(or_, [low.endswith(x) for x in MANIFEST_FILES]), "manifest")
        + points(name.endswith(".md"), "markdown")
        + points(name.rlike(r"\.(json|ya?ml|toml)$"), "config")
        + points(low.rlike(r"/(dist|target|generated|migrations)/"), "generated")
        + F.greatest(depth - 6, F.lit(0)) * IMPORTANCE["depth"]
    ).cast("long")


def context_window(lines: Column, line_no: Column, around: int = 2) -> Column:
    """Lines around a 1-based line, numbered to four places, the line itself marked."""
    low = F.greatest(line_no - around, F.lit(1))
    some = F.slice(lines, low, F.least(line_no + around, F.size(lines)) - low + 1)
    numbered = F.transform(some, lambda x, i: F.format_string("%s %4d | %s", F.when(low + i == line_no, ">>>").otherwise("   "), low + i, x))
    return F.array_join(numbered, "\n")


def minified(text: Column, most: int = 2000) -> Column:
    """One of the first five lines that aren't blank has more than ``most`` bytes; false for null."""
    full = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r")) != "")
    return F.coalesce(F.exists(F.slice(full, 1, 5), lambda x: F.octet_length(x) > most), F.lit(False))


def short_cell(cell: Column, most: int = 40) -> Column:
    """A cell of more than ``most`` bytes cut to one character fewer, with an ellipsis."""
    return F.when(F.octet_length(cell) > most, F.concat(F.left(cell, F.lit(most - 1)), F.lit("…"))).otherwise(cell)


def signature(text: Column, most: int = 240) -> Column:
    """A definition up to its body or line end, blanks as single spaces, ``most`` bytes at most."""
    head = F.regexp_extract(text, r"^[^{\n]*", 0)
    return cut_bytes(F.trim(F.regexp_replace(head, r"\s+", " ")), most)


def cut_bytes(text: Column, most: int, mark: str = "") -> Column:
    """The text's first ``most`` bytes, less those of a character that would be cut, and ``mark`` where something is left out."""
    raw = text.cast("binary")
    starts = [F.substring(raw, 1, most - i).cast("string") for i in range(4)]
    cut = F.coalesce(*[F.when(F.is_valid_utf8(x), x) for x in starts[: most + 1]], F.lit(""))
    return F.when(F.octet_length(text) > most, F.concat(cut, F.lit(mark))).otherwise(text)


def head_lines(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n", -1), 1, n), "\n")


#: The line that heads a cut text, of these endings and of all others, and the mark behind what is left out.
HASH_HEADED, HASH_HEADER, HEADER, REST = r"\.(md|txt|toml|ya?ml)$", "# TRUNCATED\n", "/* TRUNCATED */\n", "\n/* ... */\n"


def cut_unknown(path: Column, text: Column, most_bytes: int = 2048, most_lines: int = 50) -> Column:
    """A text of no known language: under a heading its first lines, with a mark where something is left out."""
    lines = F.split(F.regexp_replace(cut_bytes(text, most_bytes), r"\r?\n$", ""), r"\r?\n", -1)
    whole = F.size(F.split(F.regexp_replace(text, r"\n$", ""), "\n", -1))
    cut = (F.octet_length(text) > most_bytes) | (whole > most_lines)
    head = F.when(F.lower(path).rlike(HASH_HEADED), HASH_HEADER).otherwise(HEADER)
    return F.concat(head, F.array_join(F.slice(lines, 1, most_lines), "\n"), F.lit("\n"), F.when(cut, REST).otherwise(""))


def journal_words(text: str) -> list[str]:
    """Words between blanks of two bytes or more, then in small letters; repeated ones stay."""
    return [w.lower() for w in text.split() if len(w.encode()) >= 2]


def path_terms(text: str) -> list[str]:
    """Words between blanks in small ASCII letters, of two bytes or more."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [w.translate(low) for w in text.split() if len(w.encode()) >= 2]


def bare_name(symbol: Column) -> Column:
    """The last word of a kind and a name, in small letters."""
    return F.lower(F.element_at(F.split(F.trim(symbol), r"\s+"), -1))


def utc_time(seconds: Column) -> Column:
    """Seconds since 1970 as YYYY-MM-DD HH:MM:SS UTC, whatever the session's time zone."""
    return F.concat(F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def value_kind(json: Column) -> Column:
    """What a JSON text holds: {object}, [array], string, number, bool, null, or value where it is no JSON."""
    t = F.btrim(json, F.lit(" \t\r\n"))
    valid = F.try_parse_json(json).isNotNull()
    kind = F.when(t.startswith("{"), "{object}").when(t.startswith("["), "[array]").when(t.startswith('"'), "string").when(t.isin("true", "false"), "bool").when(t == "null", "null").otherwise("number")
    return F.when(valid, kind).otherwise("value")


def todo(line: Column) -> Column:
    return line.rlike("(?i)todo|fixme")


def has_tag(tags: Column, wanted: Sequence[str]) -> Column:
    """Some wanted tag is among the tags, in whatever case; all rows where none is wanted."""
    if not wanted:
        return F.lit(True)
    return F.coalesce(F.arrays_overlap(F.transform(tags, F.lower), F.array(*[F.lit(w.lower()) for w in wanted])), F.lit(False))


def in_scope(path: Column, scope: str) -> Column:
    """The path is the scope or lies below it; all do below ``.``."""
    scope = scope.strip("/").removeprefix("./")
    return F.lit(True) if scope in ("", ".") else (path == scope) | path.startswith(f"{scope}/")


def in_scope_of(path: Column, scope: Column) -> Column:
    """``in_scope`` of a scope that is a column, a plain path."""
    return (path == scope) | path.startswith(F.concat(scope, F.lit("/")))


def element_overhead(path: Column) -> Column:
    """Bytes that a file's element adds to its content."""
    return F.octet_length(path) + 33


def query_limit(budget: int, limit: int = 30) -> int:
    """Files that a query within a token budget asks for, of ``limit`` at most."""
    return max(1, min(max(8, min(budget // 1500, 60)), limit))


def candidate_limit(limit: int) -> int:
    return max(80, min(limit * 12, 400))


def unquoted(text: Column) -> Column:
    """The text without one pair of equal quotes around it."""
    return F.regexp_replace(text, r"""^(["'`])(.*)\1$""", "$2")


def without_fences(text: Column) -> Column:
    """The text without lines that begin with three backticks."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~F.ltrim(x).startswith("```")), "\n")

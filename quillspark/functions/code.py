"""Source texts as columns: languages, comments and strings, identifiers in context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The language of each ending.
LANGUAGES = {
    "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "mjs": "typescript", "cjs": "typescript", "py": "python", "go": "go",
    "java": "java", "cs": "csharp", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "php": "php", "rb": "ruby", "dart": "dart", "proto": "proto",
}
#: How a Markdown fence names the language of an ending.
FENCES = {"rs": "rust", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "py": "python", "go": "go", "java": "java", "cs": "csharp", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "rb": "ruby", "php": "php", "dart": "dart", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "md": "markdown", "sh": "bash", "sql": "sql"}

#: Comments and strings, by the way a language writes them; a string that never ends reaches to its line's end.
BLOCK = r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*.*?\*/)*+(?:\*/|\z)"
QUOTED = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?'
SINGLE = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?"
TICKED = r"`[^`\\]*+(?:\\.[^`\\]*+)*+`?"
TRIPLE = r'"""(?:[^"\\]|\\.|"(?!""))*+(?:"""|\z)|' + r"'''(?:[^'\\]|\\.|'(?!''))*+(?:'''|\z)"
COMMENTS = {"python": r"#[^\n]*", "ruby": r"#[^\n]*", "php": rf"{BLOCK}|//[^\n]*|#[^\n]*"}
STRINGS = {
    "python": rf"{TRIPLE}|{QUOTED}|{SINGLE}",
    "ruby": rf"{QUOTED}|{SINGLE}",
    "rust": r'r(#++)".*?"\1|r"[^"]*+"|' + QUOTED + r"|'(?:\\[^\n']++|[^'\\\n])'",
    "typescript": rf"{QUOTED}|{SINGLE}|{TICKED}",
    "go": rf"{QUOTED}|{TICKED}|" + r"'(?:\\[^\n']++|[^'\\\n])'",
    "php": rf"{QUOTED}|{SINGLE}",
    "dart": rf"{TRIPLE}|{QUOTED}|{SINGLE}",
}
C_COMMENTS, C_STRINGS = rf"{BLOCK}|//[^\n]*", rf"{QUOTED}|" + r"'(?:\\[^\n']++|[^'\\\n])'"

#: Categories of a use, in the order in which they are told and shown.
CATEGORIES = ["Type Refs", "Calls", "Field Inits", "Field Accesses", "Other"]


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def language(ext: Column) -> Column:
    """The language of an ending; null where it has none."""
    return lookup(LANGUAGES, F.lower(ext))


def fence(ext: Column) -> Column:
    return F.coalesce(lookup(FENCES, F.lower(ext)), F.lit("text"))


def _segments(text: Column, pattern: str, blank: str, keep: str | None) -> Column:
    """The text with each stretch that ``blank`` matches turned to spaces, line ends kept; ``pattern`` says where stretches begin and end."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s)({pattern}|[A-Za-z0-9_]++|\\s++|.)"), 1)

    def one(x: Column) -> Column:
        hit = x.rlike(f"(?s)\\A(?:{blank})\\z")
        if keep:
            hit &= ~x.rlike(keep)
        return F.when(hit, F.regexp_replace(x, r"[^\n]", " ")).otherwise(x)

    return F.array_join(F.transform(cut, one), "")


def _by_language(text: Column, ext: Column, blank_strings: bool, keep: str | None) -> Column:
    out = F.lit(None).cast("string")
    groups: dict[tuple[str, str], list[str]] = {}
    for name in sorted(set(LANGUAGES.values())):
        groups.setdefault((COMMENTS.get(name, C_COMMENTS), STRINGS.get(name, C_STRINGS)), []).append(name)
    for (comments, strings), names in groups.items():
        # a backward reference counts groups from the whole: the pattern's own first group is the second here
        every = f"{comments}|{strings}".replace(r"\1", r"\2")
        blank = every.replace(r"\2", r"\1") if blank_strings else comments
        out = F.when(language(ext).isin(names), _segments(text, every, blank, keep)).otherwise(out)
    return F.coalesce(out, text)


def code_only(text: Column, ext: Column) -> Column:
    """The text with comments and strings blanked: every character keeps its place. Other languages' texts stay as they are."""
    return _by_language(text, ext, True, None)


def uncommented(text: Column, ext: Column) -> Column:
    """The text with comments blanked, but for those that hold TODO or FIXME."""
    return _by_language(text, ext, False, "(?i)todo|fixme")


def category(line: Column, name: str) -> Column:
    """What the first use of a name in a line of code is: CATEGORIES, in their order, told by the marks around it."""
    word = rf"(?<![\w$]){name}(?![\w$])"
    kinds = [
        rf"(?:->\s*|\bas\s+|\bimpl\s+|\bnew\s+|\bextends\s+|\bimplements\s+|\bfor\s+(?=[A-Z])|<\s*|[\w)\]]\s*:\s*&?(?:mut\s+)?){word}(?!\s*\()|{word}\s*(?:::\s*<|<[\w\s,<>]+>\s*[({{])",
        rf"{word}\s*(?:::<[^>]*>)?\s*!?\(",
        rf"(?:^\s*|[{{,]\s*){word}\s*:(?!:)",
        rf"\.\s*{word}",
    ]
    out = F.lit(CATEGORIES[-1])
    for kind, pattern in reversed(list(zip(CATEGORIES, kinds, strict=False))):
        out = F.when(line.rlike(pattern), kind).otherwise(out)
    return out


def called_name(target: Column) -> Column:
    """The name at the end of a call's target: what follows the last dot or colons; null where it ends in no name."""
    found = F.regexp_extract(target, r"(?:^|[.:])([\p{L}_$][\p{L}\p{N}_$]*)\s*$", 1)
    return F.when(found != "", found)


def is_public(name: Column, ext: Column) -> Column:
    """A name that other files may use: without an underscore in Python, with a capital in Go, any in other languages."""
    return F.when(language(ext) == "python", ~name.startswith("_")).when(language(ext) == "go", name.rlike(r"^\p{Lu}")).otherwise(F.lit(True))

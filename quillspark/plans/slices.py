"""Slices: the files that matter most within a token budget, as elements of one context document.

A slice is small by its budget, so that its rows may meet in one task; what it is
chosen from may be of any size, and is ranked and cut before.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import edits as E
from ..functions import text as X
from ..operators import packing as B
from ..operators import relational as R
from ..operators import skeletons as L
from ..sources.scratch import Tables

#: Bytes of a document around its map and files, and limits of the map.
DOCUMENT, MAP, MAP_LINES, MAP_BYTES = 64, 40, 4000, 64 * 1024
#: What a compact manifest keeps of package.json and Cargo.toml.
PACKAGE_KEYS = ["name", "version", "private", "type", "workspaces", "main", "module", "types", "exports", "scripts", "dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
CARGO_TABLES = ["package", "lib", "bin", "workspace", "dependencies", "dev-dependencies", "build-dependencies", "features"]


def by_importance(files: DataFrame, edges: DataFrame | None = None, path: str = "rel_path") -> DataFrame:
    """files with score: the path's importance and 10 for each edge(source, target) that leads to it; edges of containment count like others where they are handed in."""
    score = X.importance(F.col(path))
    if edges is None:
        return files.withColumn("score", score)
    degree = edges.groupBy(F.col("target").alias(path)).agg(F.count(F.lit(1)).alias("__in"))
    return files.join(degree, path, "left").withColumn("score", score + 10 * F.coalesce("__in", F.lit(0))).drop("__in")


def candidates(files: DataFrame, query: str, n: int, path: str = "rel_path", size: str = "bytes") -> DataFrame:
    """The n best files for a query with their score: by the query's terms in the path, then the smaller, then by path."""
    scored = files.withColumn("score", X.path_score(F.col(path), X.path_terms(query)))
    return scored.orderBy(F.desc("score"), size, path).limit(n)


def compact_manifests(files: DataFrame) -> DataFrame:
    """files(rel_path, text, ...) with the text of package.json and Cargo.toml reduced to the keys that describe the package; what cannot be read stays whole."""
    name = F.lower(F.element_at(F.split("rel_path", "/"), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index("text")
            kinds = [p.rpartition("/")[2].lower() for p in b.column("rel_path").to_pylist()]
            texts = [compact(k, t) for k, t in zip(kinds, b.column("text").to_pylist(), strict=True)]
            yield b.set_column(i, "text", pa.array(texts, pa.string()))

    manifest = name.isin("package.json", "cargo.toml")
    return files.filter(~manifest).unionByName(files.filter(manifest).mapInArrow(run, files.schema))


def compact(name: str, text: str | None) -> str | None:
    if text is None:
        return None
    if name == "package.json":
        try:
            tree = json.loads(text)
        except ValueError:
            return text
        return json.dumps({k: tree[k] for k in PACKAGE_KEYS if k in tree}, indent=2, ensure_ascii=False, sort_keys=True) if isinstance(tree, dict) else text
    try:
        tree = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return text
    return "\n".join(toml_lines({k: tree[k] for k in sorted(CARGO_TABLES) if k in tree}, ())).lstrip("\n")


def toml_value(value: object) -> str:
    if isinstance(value, dict):
        return "{ " + ", ".join(f"{toml_key(k)} = {toml_value(value[k])}" for k in sorted(value)) + " }" if value else "{}"
    if isinstance(value, list):
        return "[" + ", ".join(map(toml_value, value)) + "]"
    return json.dumps(value, ensure_ascii=False) if isinstance(value, str | bool | int | float) else str(value)


def toml_key(key: str) -> str:
    return key if re.fullmatch(r"[A-Za-z0-9_-]+", key) else json.dumps(key, ensure_ascii=False)


def toml_lines(table: dict, above: tuple[str, ...]) -> Iterator[str]:
    """A table's lines, keys sorted: plain values first, then its tables under their headings."""
    below = lambda v: isinstance(v, dict) or (isinstance(v, list) and v and all(isinstance(x, dict) for x in v))
    if above and (not table or any(not below(v) for v in table.values())):
        yield ""
        yield f"[{'.'.join(map(toml_key, above))}]"
    for k in sorted(table):
        if not below(table[k]):
            yield f"{toml_key(k)} = {toml_value(table[k])}"
    for k in sorted(table):
        if isinstance(table[k], dict):
            yield from toml_lines(table[k], (*above, k))
        elif below(table[k]):
            for one in table[k]:
                yield ""
                yield f"[[{'.'.join(map(toml_key, (*above, k)))}]]"
                yield from (f"{toml_key(x)} = {toml_value(one[x])}" for x in sorted(one))


def contents(files: DataFrame, skeleton: bool = False, focus: str | None = None, compacted: bool = True) -> DataFrame:
    """files(rel_path, ext, text, ...) with what a slice shows of them: the focus whole, manifests compact, else skeletons
    (of unknown languages their first lines) if asked, else the whole text."""
    is_focus = F.coalesce(F.col("rel_path") == F.lit(focus), F.lit(False))
    out = files
    if skeleton:
        short = L.skeletons(files.select("rel_path", "ext", "text"))
        shown = F.when(is_focus, F.col("text")).otherwise(F.coalesce("skeleton", X.cut_unknown(F.col("rel_path"), F.col("text"))))
        name = F.lower(F.element_at(F.split("rel_path", "/"), -1))
        manifest = name.isin("package.json", "cargo.toml") if compacted else F.lit(False)
        out = files.join(short, "rel_path", "left").withColumn("text", F.when(manifest, F.col("text")).otherwise(shown)).drop("skeleton")
        out = Tables(files.sparkSession, "contents").put(out, "shown")  # what is packed is read several times, skeletons are made once
    if not compacted:
        return out
    return compact_manifests(out.filter(~is_focus)).unionByName(out.filter(is_focus))


#: The map's first line, and the one that says that paths are left out.
MAP_HEAD, MAP_END = "# REPOSITORY_MAP\n", "# ... (truncated)\n"


def repository_maps(files: DataFrame, group: str, path: str = "rel_path") -> DataFrame:
    """group and repo_map: under its heading the group's sorted paths, one a line, MAP_LINES at most and whole lines up to MAP_BYTES, with a mark where some are left out."""
    first = R.first_per(files.select(group, path), [group], [F.col(path)], MAP_LINES + 1)
    line = F.concat(F.col(path), F.lit("\n"))
    upto = F.sum(F.octet_length(line)).over(Window.partitionBy(group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)) + len(MAP_HEAD)
    shown = (F.col("rank") <= MAP_LINES) & (F.col("upto") <= MAP_BYTES)
    each = first.withColumn("upto", upto).select(group, "rank", F.when(shown, line).alias("line"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("rank", "line")))), lambda x: x["line"]), "")
    return each.groupBy(group).agg(F.concat(F.lit(MAP_HEAD), lines, F.when(F.count("line") < F.count(F.lit(1)), MAP_END).otherwise("")).alias("repo_map"))


def repository_map(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """One row: repo_map, of all files; the heading alone without any."""
    first = files.select(F.lit("").alias("all"), F.col(path)).orderBy(path).limit(MAP_LINES + 1)
    return repository_maps(first, "all", path).agg(F.coalesce(F.max("repo_map"), F.lit(MAP_HEAD)).alias("repo_map"))


def sliced(files: DataFrame, order: Sequence[str], budget: int, per_token: int = 4, path: str = "rel_path", group: str | None = None) -> DataFrame:
    """group (if any), position (from 1), path, text and tokens so far of the files that fit the budget in order; one too large is skipped.

    ``order`` names columns, a minus before one means from the largest. The
    document, its map of the group's paths and each file's element count. Paths
    are unique within a group.
    """
    rows = files.withColumn("__group", F.col(group) if group else F.lit("")).filter("__group IS NOT NULL")
    size = (F.octet_length("text") + X.element_overhead(F.col(path))).cast("long")
    maps = repository_maps(rows, "__group", path).select("__group", (F.octet_length("repo_map") + DOCUMENT + MAP).cast("long").alias("__map"))
    keys = [F.negative(F.col(c[1:])) if c.startswith("-") else F.col(c) for c in order]
    sized = rows.withColumn("__size", size).join(maps, "__group").withColumns({"__room": budget * per_token - F.col("__map"), **{f"__o{i}": k for i, k in enumerate(keys)}})
    taken = B.pack_greedy(sized, "__group", [f"__o{i}" for i in range(len(keys))], "__size", path, "__room")
    kept = sized.join(taken.select("__group", path), ["__group", path])
    at = Window.partitionBy("__group").orderBy(*[f"__o{i}" for i in range(len(keys))], path)  # what fits a budget
    tokens = X.token_estimate(F.sum("__size").over(at.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__map"), per_token)
    return kept.select(*([F.col("__group").alias(group)] if group else []), F.row_number().over(at).alias("position"), path, "text", tokens.alias("tokens"))


def document(rows: DataFrame, repo_map: DataFrame | None = None, path: str = "rel_path") -> DataFrame:
    """One row: xml, the context document of ``sliced`` rows in order, with the repository's map before them."""
    each = rows.select("position", E.file_element(F.col(path), F.col("text")).alias("e"))
    body = each.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "e"))), lambda x: x["e"]), "\n").alias("body"))
    if repo_map is None:
        return body.select(F.concat(F.lit("<context>\n"), "body", F.lit("\n</context>")).alias("xml"))
    shown = F.concat(F.lit("<repository_map><![CDATA["), F.replace("repo_map", F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]></repository_map>\n"))
    return body.crossJoin(F.broadcast(repo_map)).select(F.concat(F.lit("<context>\n"), shown, "body", F.lit("\n</context>")).alias("xml"))  # one row each


def totals(rows: DataFrame, budget: int) -> DataFrame:
    """One row: budget, total_tokens, files and bytes of a slice."""
    return rows.agg(F.lit(budget).alias("budget"), F.coalesce(F.max("tokens"), F.lit(0)).alias("total_tokens"), F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))


def plain_slice(files: DataFrame, budget: int, edges: DataFrame | None = None, skeleton: bool = False, focus: str | None = None) -> DataFrame:
    """``sliced`` files(rel_path, ext, bytes, text) by importance and path; the map of paths takes its own part of the budget."""
    shown = contents(by_importance(files, edges), skeleton, focus)
    return sliced(shown, ["-score"], budget)


def query_slice(files: DataFrame, ranked: DataFrame | None, query: str, budget: int, scope: str = ".", limit: int = 30, skeleton: bool = False) -> DataFrame:
    """``sliced`` files that a query asks for: candidates by path, in the order of ranked(rel_path, rank) where a search gives one.

    Scope counts before anything is cut. Where nothing is found, the plain slice of the scope.
    """
    inside = files.filter(X.in_scope(F.col("rel_path"), scope))
    n = X.query_limit(budget, limit)
    if ranked is None:
        hits = candidates(inside, query, X.candidate_limit(n)).filter("score > 0").orderBy(F.desc("score"), "bytes", "rel_path").limit(n)
        hits = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "bytes", "rel_path")))
    else:
        hits = inside.join(ranked.select("rel_path", "rank"), "rel_path").orderBy("rank").limit(n)
    if hits.isEmpty():
        return plain_slice(inside, budget, skeleton=skeleton)
    return sliced(contents(hits, skeleton, compacted=False), ["rank"], budget)


def member_slices(files: DataFrame, members: DataFrame, budget: int, least: int = 4000) -> DataFrame:
    """member, position, rel_path, text and tokens: each workspace member(root) packs its files by importance into its share of
    the budget (``least`` tokens at least), then all members' files together, members by name, stay within the whole."""
    n = max(1, members.count())
    share = min(max(budget // n, least), budget)
    own = R.longest_prefix(files.select("rel_path").distinct(), members.select(F.col("root").alias("member")), "rel_path", "member").filter("member IS NOT NULL")
    each = sliced(by_importance(files.join(own, "rel_path")), ["-score"], share, group="member")
    first = each.withColumn("size", F.octet_length("text") + X.element_overhead(F.col("rel_path"))).withColumn("all", F.lit(0))
    kept = B.pack_greedy(first, "all", ["member", "position"], "size", "rel_path", budget * 4, fixed=DOCUMENT)
    return each.join(kept.select("rel_path"), "rel_path", "left_semi").select("member", "position", "rel_path", "text", "tokens")

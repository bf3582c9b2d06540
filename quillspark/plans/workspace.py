"""One budget shared down a workspace: its map, the files at its root, its members and their files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import packing as B
from ..operators import relational as R
from ..sources.scratch import Tables
from . import slices as L

#: Bytes of a workspace's map, least and most tokens for its root, least tokens of a member, quoted paths that make a Cargo workspace large.
MAP_BYTES, ROOT_LEAST, ROOT_MOST, MEMBER_LEAST, MANY_PATHS = 96 * 1024, 500, 2000, 4000, 5
#: The member that files at the root belong to, and that of files in folders of no member.
ROOT, OTHER = ".", "*"
MAP_HEAD, ROOT_HEAD, MAP_END = "# REPOSITORY_MAP", "# ROOT (workspace root)", "# ... (truncated)"


def owned(files: DataFrame, members: DataFrame) -> DataFrame:
    """files with member: the root of the innermost of members(root) that holds them, ROOT for those in no folder, OTHER for the rest."""
    roots = members.select(F.col("root").alias("member")).filter(~F.col("member").isin("", ROOT))
    of = R.longest_prefix(files.select("rel_path").distinct(), roots, "rel_path", "member").toDF("__path", "__member")
    none = F.when(F.contains("rel_path", F.lit("/")), OTHER).otherwise(ROOT)
    return files.join(of, F.col("rel_path") == F.col("__path")).withColumn("member", F.coalesce("__member", none)).drop("__path", "__member")


def place(member: str = "member") -> F.Column:
    """0 for the root, 1 for members, 2 for what is outside of them."""
    return F.when(F.col(member) == ROOT, 0).when(F.col(member) == OTHER, 2).otherwise(1)


def workspace_map(files: DataFrame, members: DataFrame) -> DataFrame:
    """One row: repo_map, of files(rel_path, member, score): the root's heading, then each member's with its paths, the most important first.

    Lines are whole; beyond MAP_BYTES a mark stands in place of the rest. A line
    has a byte at least, so that the first MAP_BYTES lines are enough.
    """
    names = members.select(F.col("root").alias("member"), F.col("name").alias("n") if "name" in members.columns else F.lit(None).cast("string").alias("n")).distinct()
    heads = files.filter(F.col("member") != ROOT).select("member").distinct().join(names, "member", "left")
    name = F.coalesce("n", F.element_at(F.split("member", "/"), -1))
    head = F.when(F.col("member") == OTHER, "# OTHER (outside of members)").otherwise(F.concat(F.lit("# "), name, F.lit(" ("), "member", F.lit(")")))
    lines = heads.select(place().alias("place"), "member", F.lit(None).cast("long").alias("key"), F.lit("").alias("rel_path"), head.alias("line"))
    paths = files.filter(F.col("member") != ROOT).select(place().alias("place"), "member", F.negative("score").cast("long").alias("key"), "rel_path", F.col("rel_path").alias("line"))
    order = ["place", "member", F.asc_nulls_first("key"), "rel_path"]
    first = lines.unionByName(paths).orderBy(*order).limit(MAP_BYTES)
    at = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # as many rows as a map has bytes at most
    top = f"{MAP_HEAD}\n{ROOT_HEAD}\n"
    upto = first.withColumns({"upto": F.sum(F.octet_length("line") + 1).over(at) + len(ROOT_HEAD) + 1, "no": F.count(F.lit(1)).over(at)})
    shown = F.when(F.col("upto") <= MAP_BYTES, F.struct("no", "line"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(shown)), lambda x: x["line"]), "\n")
    cut = F.count(shown) < F.count(F.lit(1))
    return upto.agg(F.concat(F.lit(top), F.when(F.count(shown) > 0, F.concat(F.lit("\n"), body)).otherwise(""), F.when(cut, f"\n{MAP_END}\n").otherwise("")).alias("repo_map"))


def level(needs: DataFrame, room: int) -> int:
    """The share at which members(need) that need more are cut, so that together they take ``room``; the largest need where all fits.

    What those that need less leave over raises the share of the others. The
    share only rises, so that repeated sums find it; each sends one row to the
    driver.
    """
    all_ = needs.agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("most")).first()
    share, before = (room // all_.n if all_.n else 0), None
    while True:
        over = F.col("need") > share
        got = needs.agg(F.coalesce(F.sum(F.when(~over, F.col("need"))), F.lit(0)).alias("held"), F.count_if(over).alias("n")).first()
        if not got.n:
            return all_.most or 0
        if got.n == before:
            return share
        share, before = max(share, (room - got.held) // got.n), got.n


def workspace_slice(files: DataFrame, members: DataFrame, budget: int, least: int = MEMBER_LEAST, skeleton: bool = False, edges: DataFrame | None = None, per_token: int = 4) -> tuple[DataFrame, DataFrame]:
    """member, position, rel_path, text and tokens so far of the files(rel_path, ext, bytes, text) that a workspace shows, and its map (one row).

    The document and the map are paid first. Files at the root follow by path up
    to the first that breaks a tenth of the budget (500 to 2,000 tokens). The
    rest is shared by the members(root, name) and what lies outside of them: each
    gets what it needs or the same ``level``, ``least`` tokens at least while they
    last, members by name, and packs its files by importance, skipping those
    too large. What is then left is offered to the files left out, in the same
    order. Without members all lies outside. The total stays within the budget.
    """
    tables = Tables(files.sparkSession, "workspace")
    scored = L.by_importance(owned(files, members), edges)
    repo_map = tables.put(workspace_map(scored, members), "map")
    shown = shown_texts(scored, skeleton)
    size = (F.octet_length("text") + X.element_overhead(F.col("rel_path"))).cast("long")
    sizes = tables.put(shown.select("member", place().alias("place"), "rel_path", F.negative("score").alias("key"), size.alias("size")), "sizes")
    fixed = L.DOCUMENT + L.MAP + repo_map.select(F.octet_length("repo_map")).first()[0]
    room = max(0, budget * per_token - fixed)
    at_root = min(min(max(budget // 10, ROOT_LEAST), ROOT_MOST) * per_token, room)
    root = tables.put(B.within_budget(sizes.filter("place = 0"), None, [F.col("rel_path")], F.col("size"), at_root).select("rel_path", "size"), "root")
    rest = room - (root.agg(F.sum("size")).first()[0] or 0)
    inside = sizes.filter((F.col("place") > 0) & (F.col("size") <= rest))
    needs = tables.put(inside.groupBy("place", "member").agg(F.sum("size").alias("need")), "needs")
    share = max(level(needs, rest), least * per_token)
    allotted = B.running(needs, F.lit(0), [F.col("place"), F.col("member")], F.least("need", F.lit(share)))
    before = F.lit(rest) - (F.col("upto") - F.col("s"))
    rooms = allotted.select(F.col("row.member").alias("member"), F.greatest(F.lit(0), F.least("s", before)).alias("room"))
    own = B.pack_greedy(inside.join(rooms, "member"), "member", ["key"], "size", "rel_path", "room").select("rel_path")
    first = tables.put(inside.join(own, "rel_path", "left_semi"), "first")
    left = rest - (first.agg(F.sum("size")).first()[0] or 0)
    over = inside.join(first, "rel_path", "left_anti").filter(F.col("size") <= left).withColumn("all", F.lit(0))
    more = B.pack_greedy(over, "all", ["place", "member", "key"], "size", "rel_path", left).select("rel_path")
    paths = root.select("rel_path").unionByName(first.select("rel_path")).unionByName(more)
    kept = sizes.join(tables.put(paths, "paths"), "rel_path", "left_semi")
    at = Window.orderBy("place", "member", F.when(F.col("place") > 0, F.col("key")), "rel_path").rowsBetween(Window.unboundedPreceding, 0)  # what fits the budget
    tokens = X.token_estimate(F.sum("size").over(at) + fixed, per_token)
    numbered = kept.select("member", F.count(F.lit(1)).over(at).cast("int").alias("position"), "rel_path", tokens.alias("tokens"))
    texts = shown.select("rel_path", "text").join(tables.put(numbered, "numbered"), "rel_path")
    return texts.select("member", "position", "rel_path", "text", "tokens"), repo_map


def shown_texts(scored: DataFrame, skeleton: bool) -> DataFrame:
    """``slices.contents`` of files(member, ...); those at the root are cut, manifests compact."""
    root = F.col("member") == ROOT
    inside = L.contents(scored.filter(~root), skeleton)
    name = F.lower("rel_path")
    manifest = name.endswith("cargo.toml") | name.endswith("package.json")
    cut = F.when(manifest, F.col("text")).otherwise(X.cut_unknown(F.col("rel_path"), F.col("text")))
    return inside.unionByName(L.compact_manifests(scored.filter(root).withColumn("text", cut)))


def is_large(files: DataFrame) -> bool:
    """The root's Cargo.toml quotes MANY_PATHS texts or more, or its package.json is an object with workspaces."""
    quotes = F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))
    cargo = (F.col("rel_path") == "Cargo.toml") & (F.floor(quotes / 2) >= MANY_PATHS)
    package = (F.col("rel_path") == "package.json") & F.array_contains(F.json_object_keys("text"), "workspaces")
    return not files.filter(F.col("rel_path").isin("Cargo.toml", "package.json")).filter(cargo | package).isEmpty()


def hint(files: DataFrame, target: str, most: int = 5) -> list[str]:
    """Up to five names beside a target that does not exist, by path, whose last part holds the target's stem; the whole workspace's top where its folder is not there."""
    folder, _, last = target.strip("/").rpartition("/")
    if folder and files.filter(X.in_scope(F.col("rel_path"), folder)).isEmpty():
        folder = ""
    stem = (last.rpartition(".")[0] or last).lower()
    depth = folder.count("/") + 2 if folder else 1
    entry = F.array_join(F.slice(F.split("rel_path", "/"), 1, depth), "/")
    beside = files.filter(X.in_scope(F.col("rel_path"), folder or ".")).select(entry.alias("e")).distinct()
    found = beside.filter(F.contains(F.lower(F.element_at(F.split("e", "/"), -1)), F.lit(stem)))
    return [r.e for r in found.orderBy("e").limit(most).collect()]


def deep_slice(files: DataFrame, target: str = ".", budget: int = 32_000, *, members: DataFrame | None = None, query: str | None = None, ranked: DataFrame | None = None, limit: int = 30, only_dir: str | None = None,
               exclude: Sequence[str] = (), single_file: bool = False, skeleton: bool = False, huge: bool = False, edges: DataFrame | None = None) -> DataFrame:
    """position, rel_path, text and tokens of what a call asks for: a query's files, the whole workspace by members, or the target's files by importance.

    ``exclude`` names folders that are left out. A query searches ``only_dir`` or
    else the target, in the order of ranked(rel_path, rank) where a search gives
    one; ``single_file`` passes it by. The workspace is cut by members where it
    ``is_large`` (or ``huge``) and the target is its root. A target that is a
    file is shown whole. One that does not exist is an error that names what
    stands beside it.
    """
    parts = F.split("rel_path", "/")
    kept = files.filter(~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(x) for x in exclude]))) if exclude else files
    inside = kept.filter(X.in_scope(F.col("rel_path"), target))
    whole = target.strip("/") in ("", ".", "./")
    if not whole and files.filter(X.in_scope(F.col("rel_path"), target)).isEmpty():
        beside = hint(files, target)
        raise ValueError(f"target {target!r} does not exist" + (f"; did you mean one of {', '.join(map(repr, beside))}?" if beside else ""))
    names = ["position", "rel_path", "text", "tokens"]
    if query and not single_file:
        return L.query_slice(kept, ranked, query, budget, only_dir or target, limit, skeleton).select(*names)
    if whole and members is not None and (huge or is_large(files)) and not members.filter(~F.col("root").isin("", ROOT)).isEmpty():
        return workspace_slice(inside, members, budget, skeleton=skeleton, edges=edges)[0].select(*names)
    focus = target.strip("/").removeprefix("./")
    return L.plain_slice(inside, budget, edges, skeleton, focus).select(*names)

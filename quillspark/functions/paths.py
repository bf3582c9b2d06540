"""Functions over paths, addresses and file names."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a relative import may add to reach a file, in order of choice.
IMPORT_ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".rs", ".py", ".go", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


def glob_regex(glob: str) -> str:
    """The pattern that a whole path meets if the glob names it: ``**/`` any folders, ``*`` and ``?`` within one segment."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^{out}$"


def matches_globs(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Some included glob names the path (none included: all do) and no excluded one; a null path is never kept."""
    some = lambda globs: reduce(or_, [path.rlike(glob_regex(g)) for g in globs], F.lit(False))
    return F.coalesce(path.isNotNull() & (some(include) if include else F.lit(True)) & ~some(exclude), F.lit(False))


def normal_path(path: Column) -> Column:
    """Forward slashes only, without ``./`` at the start and slashes at the end."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./+)+", ""), r"(?<=.)/+$", "")


def uri_path(uri: Column) -> Column:
    """The path of an address: what follows scheme and host, without query and fragment; a drive letter loses the slash before it."""
    path = F.regexp_replace(F.regexp_replace(uri, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.regexp_replace(path, r"^/(?=[A-Za-z]:)", "")


def safe_name(name: Column) -> Column:
    """A file name: runs of other characters than letters, digits, dots, dashes and underscores become one underscore."""
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def joined(folder: Column, target: Column) -> Column:
    """The path that target means from a folder, of any depth: ``.`` and empty parts go, ``..`` takes the part before it; null where it leads out of the top, ``.`` for the top itself.

    The parts are folded with a stack; a target that begins with a slash starts from the top.
    """
    start = F.when(target.startswith("/"), "").otherwise(folder)
    parts = F.split(F.concat(start, F.lit("/"), F.replace(target, F.lit("\\"), F.lit("/"))), "/")
    empty = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(False).alias("out"))

    def step(state: Column, part: Column) -> Column:
        n = F.size(state["stack"])
        up = F.struct(F.slice(state["stack"], F.lit(1), F.greatest(n - 1, F.lit(0))).alias("stack"), (state["out"] | (n == 0)).alias("out"))
        down = F.struct(F.concat(state["stack"], F.array(part)).alias("stack"), state["out"].alias("out"))
        return F.when(part.isin("", "."), state).when(part == "..", up).otherwise(down)

    done = F.aggregate(parts, empty, step)
    return F.when(~done["out"], F.when(F.size(done["stack"]) == 0, ".").otherwise(F.array_join(done["stack"], "/")))


def relative_to(path: Column, root: Column) -> Column:
    """The path below a root, both normalised; ``.`` for the root itself, the whole path where it lies elsewhere."""
    path, root = normal_path(path), normal_path(root)
    return F.when(path == root, ".").when(path.startswith(F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)


def import_candidates(folder: Column, target: Column) -> Column:
    """Files that a relative import may mean, best first; empty unless the target starts with a dot and stays below the top."""
    inside = joined(folder, target)
    each = F.array(*[F.concat(inside, F.lit(x)) for x in IMPORT_ENDINGS])
    return F.when(target.startswith(".") & inside.isNotNull(), each).otherwise(F.array().cast("array<string>"))

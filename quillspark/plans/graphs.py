"""Graphs of files and modules: containment, imports and declared dependencies (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..operators import relational as R
from ..operators import sections as C

#: Files that mark the root of a module.
MARKERS = ["cargo.toml", "package.json", "pyproject.toml", "setup.py", "go.mod", "pubspec.yaml", "pom.xml", "build.gradle"]
#: Weight of a declared dependency, in imports.
DECLARED = 5


def folder_of(path):
    return F.regexp_replace(path, r"/?[^/]*$", "")


def listing(files: DataFrame, folder: str = "", deny: tuple[str, ...] = (), endings: tuple[str, ...] = ()) -> DataFrame:
    """path, kind and bytes of a folder's immediate children: files (of the endings, if any) and folders (sizes summed), but denied names."""
    head = folder.strip("/") + "/" if folder.strip("/") not in ("", ".") else ""
    rest = F.substring("rel_path", len(head) + 1, 1 << 20)
    below = files.filter(F.col("rel_path").startswith(head)).withColumn("name", F.split(rest, "/")[0]).withColumn("kind", F.when(F.contains(rest, F.lit("/")), "folder").otherwise("file"))
    below = below.filter(~F.col("name").isin(*deny)) if deny else below
    if endings:
        below = below.filter((F.col("kind") == "folder") | F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(*endings))
    return below.groupBy(F.concat(F.lit(head), "name").alias("path"), "kind").agg(F.sum("bytes").alias("bytes"))


def nodes(rows: DataFrame) -> DataFrame:
    """id, label, kind, bytes, est_tokens and size_class of rows(path, kind, bytes)."""
    return rows.select(F.col("path").alias("id"), F.element_at(F.split("path", "/"), -1).alias("label"), "kind", "bytes", X.token_estimate(F.col("bytes")).alias("est_tokens"), X.size_class(F.col("bytes")).alias("size_class"))


def import_edges(files: DataFrame, imports: DataFrame) -> DataFrame:
    """source and target of each relative import(rel_path, imports) that means one of the files, each once."""
    asked = imports.filter(F.col("imports").startswith(".")).select("rel_path", "imports").distinct()
    found = C.resolve(asked, P.import_candidates(folder_of(F.col("rel_path")), F.col("imports")), files.select(F.col("rel_path").alias("target")), "target")
    return found.filter("target IS NOT NULL AND target <> rel_path").select(F.col("rel_path").alias("source"), "target").distinct()


def repo_map(files: DataFrame, imports: DataFrame, folder: str = "") -> tuple[DataFrame, DataFrame]:
    """Nodes of a folder and its immediate children, and edges: contains, and imports among those children."""
    root = folder.strip("/") or "."
    own = listing(files, folder)
    top = own.agg(F.lit(root).alias("path"), F.lit("folder").alias("kind"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    contains = own.select(F.lit(root).alias("source"), F.col("path").alias("target"), F.lit("contains").alias("kind"))
    inside = import_edges(files, imports)
    for end in ("source", "target"):
        inside = inside.join(own.filter("kind = 'file'").select(F.col("path").alias(end)), end, "left_semi")
    return nodes(top.unionByName(own)), contains.unionByName(inside.select("source", "target", F.lit("imports").alias("kind")))


def module_roots(files: DataFrame) -> DataFrame:
    """root of each folder that holds a marker file; the top is ``.``."""
    name = F.lower(F.element_at(F.split("rel_path", "/"), -1))
    root = folder_of(F.col("rel_path"))
    return files.filter(name.isin(MARKERS)).select(F.when(root == "", ".").otherwise(root).alias("root")).distinct()


def owners(files: DataFrame, roots: DataFrame) -> DataFrame:
    """rel_path and the nearest module root above it; ``.`` where none is nearer."""
    found = R.longest_prefix(files.select("rel_path").distinct(), roots.filter("root <> '.'"), "rel_path", "root")
    return found.select("rel_path", F.coalesce("root", F.lit(".")).alias("module"))


def module_nodes(files: DataFrame, of: DataFrame) -> DataFrame:
    """id, label, file_count, bytes, est_tokens and size_class of each module."""
    sums = files.join(of, "rel_path").groupBy("module").agg(F.count(F.lit(1)).alias("file_count"), F.sum("bytes").alias("bytes"))
    return sums.select(F.col("module").alias("id"), F.element_at(F.split("module", "/"), -1).alias("label"), "file_count", "bytes", X.token_estimate(F.col("bytes")).alias("est_tokens"), X.size_class(F.col("bytes")).alias("size_class"))


def declared_modules(declared: DataFrame, roots: DataFrame) -> DataFrame:
    """module and path: of declared(module, path), the folders that manifests name relative to their own module's, those that are a root(root), as its path from the top."""
    own = F.when(F.col("module") == ".", "").otherwise(F.col("module"))
    meant = declared.select("module", P.joined(own, F.col("path")).alias("path")).filter("path IS NOT NULL")
    return meant.join(roots.select(F.col("root").alias("path")), "path", "left_semi").select("module", "path").distinct()


def module_edges(edges: DataFrame, of: DataFrame, packages: DataFrame | None = None, imports: DataFrame | None = None, declared: DataFrame | None = None) -> DataFrame:
    """source, target and weight between different modules: imports of files count one, declared dependencies five.

    edges(source, target) are of files; imports(rel_path, imports) are met with
    packages(name, module) by the import's first part, dashes as underscores;
    declared(module, path) name another module's folder from the top (``declared_modules``). Packages are few, but
    nothing is broadcast by force.
    """
    a, b = of.toDF("source", "from"), of.toDF("target", "to")
    links = edges.join(a, "source").join(b, "target").select("from", "to", F.lit(1).alias("w"))
    if packages is not None and imports is not None:
        plain = lambda c: F.replace(c, F.lit("-"), F.lit("_"))
        named = imports.select("rel_path", plain(F.regexp_extract("imports", r"^(@[^/]+/[^/]+|[\w-]+)", 1)).alias("name"))
        by_name = named.join(packages.select(plain(F.col("name")).alias("name"), F.col("module").alias("to")), "name").join(of.toDF("rel_path", "from"), "rel_path")
        links = links.unionByName(by_name.select("from", "to", F.lit(1).alias("w")))
    if declared is not None:
        links = links.unionByName(declared.select(F.col("module").alias("from"), F.col("path").alias("to"), F.lit(DECLARED).alias("w")))
    return R.edge_weights(links, "from", "to", F.col("w")).toDF("source", "target", "weight")


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("target").agg(F.count(F.lit(1)).alias("in_degree"))

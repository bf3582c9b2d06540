"""Files, lines, delimited text, journals and rules as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import glob_regex, matches_globs

#: Limits on a file's bytes, and folders, names and endings that a scan leaves out.
MOST_BYTES, EVER_BYTES = 524_288, 1_000_000
SKIPPED_FOLDERS = (
    ".git node_modules dist build coverage .next .nuxt .vscode-test .vscode out .turbo .svelte-kit target __pycache__ .venv venv .env env .tox .pytest_cache .mypy_cache .ruff_cache htmlcov .hypothesis site-packages "
    ".dart_tool .pub .pub-cache .flutter-plugins .flutter-plugins-dependencies vendor .bundle .gradle .m2 .terraform .serverless tmp temp logs .cache"
).split()
SKIPPED_NAMES = "package-lock.json pnpm-lock.yaml yarn.lock Cargo.lock".split()
SKIPPED_ENDINGS = r"\.(lock|map|svg|png|ico|jpg|jpeg|gif|pyc|pyo|pyd|class|o|a|so|dylib|dll|exe|wasm|min\.js|min\.css)$"


def ignore_rules(text: str) -> list[tuple[bool, str]]:
    """(kept again, pattern of a whole path) for each line of an ignore file, in order.

    Understood are comments, ``!`` for what is kept again, names at any depth,
    paths from the top, folders with all below them, and globs. Of several
    lines that match the last decides; a file below an ignored folder may be
    kept again here, where git would not look into the folder.
    """
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        again, line = line.startswith("!"), line.lstrip("!")
        folder, line = line.endswith("/"), line.rstrip("/")
        glob = line.lstrip("/") if "/" in line else "**/" + line
        pattern = glob_regex(glob)[1:-1]
        out.append((again, f"^{pattern}" + ("/.*$" if folder else "(/.*)?$")))
    return out


def ignored(path: Column, rules: Sequence[tuple[bool, str]]) -> Column:
    """The last rule that matches the path says that it is left out."""
    out = F.lit(False)
    for again, pattern in rules:
        out = F.when(path.rlike(pattern), F.lit(not again)).otherwise(out)
    return out


def ignore_table(ignores: DataFrame) -> DataFrame:
    """folder, line_no, again and pattern of every rule of ignores(folder, text), the ignore files of any folders ('' is the top)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f, i, *rule) for f, t in zip(b.column("folder").to_pylist(), b.column("text").to_pylist(), strict=True) for i, rule in enumerate(ignore_rules(t or ""))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.string(), pa.int32(), pa.bool_(), pa.string()), strict=True)], names=["folder", "line_no", "again", "pattern"])

    return ignores.select("folder", "text").mapInArrow(run, "folder string, line_no int, again boolean, pattern string")


def kept_by_ignores(files: DataFrame, ignores: DataFrame) -> DataFrame:
    """Of files(rel_path, ...) those that the ignore files of their folders leave in.

    A file meets the rules of all folders above it by an equi-join on the
    folder, each with the path below that folder; of all rules that match, the
    last line of the deepest folder decides.
    """
    parts = F.split("rel_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder"), F.array_join(F.slice(parts, n + 1, F.size(parts)), "/").alias("below")))
    met = files.select("rel_path", F.explode(above).alias("a")).select("rel_path", "a.*").join(ignore_table(ignores), "folder").filter(F.rlike("below", F.col("pattern")))
    gone = met.groupBy("rel_path").agg(F.max_by("again", F.struct("depth", "line_no")).alias("again")).filter(~F.col("again"))
    return files.join(gone.select("rel_path"), "rel_path", "left_anti")


def wanted(files: DataFrame, most_bytes: int = MOST_BYTES, skip: Sequence[str] = (), rules: Sequence[tuple[bool, str]] = (), hidden: bool = False) -> DataFrame:
    """Of files(rel_path, bytes, ...) those that a scan keeps: not empty, not too large, in no skipped or hidden folder, of no skipped name or ending, not ignored."""
    parts = F.split("rel_path", "/")
    folders, name = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)
    keep = (F.col("bytes") > 0) & (F.col("bytes") <= min(most_bytes, EVER_BYTES)) & ~F.col("rel_path").rlike(SKIPPED_ENDINGS) & ~name.isin(SKIPPED_NAMES)
    keep &= ~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in [*SKIPPED_FOLDERS, *skip]]))
    if not hidden:
        keep &= ~F.exists(parts, lambda x: x.startswith(".") & ~x.isin(".", ".."))
    return files.filter(keep & ~ignored(F.col("rel_path"), rules))


def found(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, ext, bytes and content of all files below a folder, or of one file.

    Spark itself passes over files in a folder whose names begin with a dot or an underscore; name such a file to read it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.split(":", 1)[-1].rstrip("/").lstrip("/")
    rel = F.regexp_replace("path", "^[a-z]+:/+" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in base) + "/", "")
    one = F.regexp_replace(rel, r"^[a-z]+:/+.*/", "")  # a single file is its own root
    ext = F.lower(F.regexp_extract(one, r"\.([^./]+)$", 1))
    return files.select(one.alias("rel_path"), ext.alias("ext"), F.col("length").alias("bytes"), "content")


def scan(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES, skip: Sequence[str] = (), ignore: str = "", hidden: bool = False, ignores: DataFrame | None = None) -> DataFrame:
    """``found`` files that are ``wanted``; ``ignore`` is the text of an ignore file at the top, ignores(folder, text) those of any folders.

    Sizes and names are tested before content is read, as binaryFile prunes its
    columns. Order by rel_path where it is shown; a table has none.
    """
    kept = wanted(found(spark, root), most_bytes, skip, ignore_rules(ignore), hidden)
    return kept if ignores is None else kept_by_ignores(kept, ignores)


def funnel(files: DataFrame, kept: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """One row of scanned, kept, empty, too_large and otherwise dropped files, and the first paths of those dropped."""
    counts = files.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("bytes") == 0).alias("empty"), F.count_if(F.col("bytes") > MOST_BYTES).alias("too_large"))
    rows = counts.crossJoin(kept.agg(F.count(F.lit(1)).alias("kept")))  # one row each
    dropped = files.select("rel_path").join(kept.select("rel_path"), "rel_path", "left_anti").orderBy("rel_path").limit(most)
    return rows.withColumn("other", F.col("scanned") - F.col("kept") - F.col("empty") - F.col("too_large")), dropped


def texts(files: DataFrame, strict: bool = False) -> DataFrame:
    """files with text instead of content; files with a zero byte are left out, and, if strict, those that aren't UTF-8."""
    kept = files.filter(~F.contains(F.col("content"), F.unhex(F.lit("00"))))
    raw = F.col("content").cast("string")
    return (kept.filter(F.is_valid_utf8(raw)) if strict else kept).withColumn("text", F.make_valid_utf8(raw)).drop("content")


def lines(texts: DataFrame, key: str = "rel_path", text: str = "text") -> DataFrame:
    """key, line_no (from 1) and line of every line."""
    return texts.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """A comma- or tab-separated table with a header, all cells strings; short rows get nulls."""
    return spark.read.csv(path, header=True, sep="\t" if path.endswith(".tsv") else ",", inferSchema=False, mode="PERMISSIVE")


JOURNAL_TEXT = ["schema_version", "id", "session_id", "timestamp", "source_ide", "project_path", "intent", "decision"]
JOURNAL_LISTS = ["tool_calls", "files_touched", "tags"]
JOURNAL = T.StructType(
    [T.StructField(c, T.StringType()) for c in JOURNAL_TEXT] + [T.StructField(c, T.ArrayType(T.StringType())) for c in JOURNAL_LISTS] + [T.StructField("vector", T.ArrayType(T.FloatType()))]
)


def journal(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON-lines journal; lines that aren't JSON or lack a text field are left out, missing lists are empty, and so is a missing journal."""
    try:
        rows = spark.read.schema(JOURNAL).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], JOURNAL)
    rows = rows.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in JOURNAL_TEXT]))
    return rows.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in JOURNAL_LISTS})


def merge_rules(low: Mapping, high: Mapping) -> dict:
    """Two rule trees as one: maps merge, lists unite in order, else the higher tier's value stands."""
    out = dict(low)
    for key, value in high.items():
        old = out.get(key)
        if isinstance(old, Mapping) and isinstance(value, Mapping):
            out[key] = merge_rules(old, value)
        elif isinstance(old, list) and isinstance(value, list):
            out[key] = old + [x for x in value if x not in old]
        else:
            out[key] = value
    return out


def network(spark: SparkSession, path: str) -> DataFrame:
    """id and path of each entry of a JSON map of code bases: a list, or one under ``codebases``."""
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("t"))
    kind = "array<struct<id: string, path: string>>"
    rows = text.select(F.explode(F.coalesce(F.from_json(F.get_json_object("t", "$.codebases"), kind), F.from_json("t", kind))).alias("e"))
    return rows.select("e.id", "e.path").filter("id IS NOT NULL AND path IS NOT NULL")


def allowed(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked(target) with path: that of the known(id, path) which it names by id or by path; others are left out."""
    names = known.select(F.col("id").alias("target"), "path").unionByName(known.select(F.col("path").alias("target"), "path"))
    return asked.join(names.distinct(), "target")


def manifests(files: DataFrame) -> DataFrame:
    """rel_path, kind and name of packages that manifests(rel_path, text) describe: Cargo, npm, pubspec, go.mod, pyproject; the folder's name where none is told."""
    file = F.lower(F.element_at(F.split("rel_path", "/"), -1))
    section = F.regexp_extract("text", r"(?ms)^\[(?:package|project)\]\s*$(.*?)(?:^\[|\z)", 1)
    quoted = F.regexp_extract(section, r"(?m)^\s*name\s*=\s*[\"']([^\"']+)", 1)
    kinds = {"cargo.toml": ("cargo", quoted), "pyproject.toml": ("python", quoted), "package.json": ("npm", F.get_json_object("text", "$.name")), "pubspec.yaml": ("dart", F.regexp_extract("text", r"(?m)^name:\s*['\"]?([\w-]+)", 1)), "go.mod": ("go", F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1))}
    kind = name = F.lit(None).cast("string")
    for k, (what, told) in kinds.items():
        kind, name = F.when(file == k, what).otherwise(kind), F.when((file == k) & (told != ""), told).otherwise(name)
    folder = F.element_at(F.split(F.concat(F.lit("./"), "rel_path"), "/"), -2)
    return files.select("rel_path", kind.alias("kind"), F.coalesce(name, folder).alias("name")).filter("kind IS NOT NULL")


def path_dependencies(files: DataFrame) -> DataFrame:
    """rel_path and path of each dependency that a Cargo manifest declares by path."""
    cargo = files.filter(F.lower("rel_path").rlike(r"(^|/)cargo\.toml$"))
    return cargo.select("rel_path", F.explode(F.regexp_extract_all("text", F.lit(r"path\s*=\s*[\"']([^\"']+)"), 1)).alias("path"))


def members(files: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), depth: int = 3) -> DataFrame:
    """root, kind, name and depth of workspace members: folders with a manifest, ``depth`` folders down at most or named by a glob; by depth and path."""
    root = F.regexp_replace("rel_path", r"/?[^/]*$", "")
    rows = manifests(files).withColumn("root", F.when(root == "", ".").otherwise(root))
    rows = rows.withColumn("depth", F.when(F.col("root") == ".", 0).otherwise(F.size(F.split("root", "/"))))
    declared = matches_globs(F.col("root"), include) if include else F.lit(False)
    rows = rows.filter(((F.col("depth") <= depth) | declared) & ~matches_globs(F.col("root"), exclude) if exclude else (F.col("depth") <= depth) | declared)
    return rows.groupBy("root", "depth").agg(F.min(F.struct("kind", "name")).alias("m")).select("root", "m.kind", "m.name", "depth").orderBy("depth", "root")


def merged_rules(tiers: Sequence[Mapping], sync: bool = True, team: str | None = None) -> dict:
    """Rules of the tiers global, team and project as one tree, later ones over earlier; the team's count only if ``sync`` and a team are set."""
    out: dict = {}
    for i, tier in enumerate(tiers):
        if i != 1 or (sync and team):
            out = merge_rules(out, tier)
    return out or {"status": "no_rules_found"}


def rules_for(rules: Mapping, path: str, classes: Mapping[str, Sequence[str]]) -> dict:
    """The top-level rules that concern a path: classes names keywords of rule names by the kind of path (an ending or folder) to which alone they apply."""
    own = [words for part, words in classes.items() if path.endswith(part) or f"/{part}/" in f"/{path}"]
    bound = {w for words in classes.values() for w in words}
    mine = {w for words in own for w in words}
    return {k: v for k, v in rules.items() if not any(w in k.lower() for w in bound) or any(w in k.lower() for w in mine)}

"""Looking into data files: tables, texts, JSON, YAML, TOML and Markdown."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import packing as B
from ..operators import sections as C
from ..sources import files

#: Which reader takes which ending; the first that knows it.
READERS = {"structured": "json yaml yml toml md markdown".split(), "table": "csv tsv".split(), "text": "log txt env ini cfg conf sql".split()}


def reader_of(path: str) -> str | None:
    """The reader of a file by its ending; null for others."""
    ext = path.rpartition(".")[2].lower()
    return next((k for k, endings in READERS.items() if ext in endings), None)


def whole(spark: SparkSession, path: str) -> DataFrame:
    """rel_path and text of each file below a path."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("rel_path"), F.col("value").alias("text"))


def table_overview(rows: DataFrame, most: int = 50) -> DataFrame:
    """The first rows of a table, 50 at most, long cells cut."""
    return rows.limit(min(most, 50)).select(*[X.short_cell(F.col(f"`{c}`").cast("string")).alias(c) for c in rows.columns])


def text_overview(texts: DataFrame, head: int = 30, tail: int = 10) -> DataFrame:
    """rel_path, line_no and line of each text's first ``head`` and last ``tail`` lines; a text that is no longer than both is shown whole."""
    rows = files.lines(texts)
    n = rows.groupBy("rel_path").agg(F.max("line_no").alias("n"))
    return rows.join(n, "rel_path").filter((F.col("line_no") <= head) | (F.col("line_no") > F.col("n") - tail)).drop("n")


def as_json(texts: DataFrame) -> DataFrame:
    """rel_path, json and error of JSON, YAML and TOML texts; what cannot be read has its error and null."""

    def one(path: str, text: str | None) -> tuple[str | None, str | None]:
        ext = path.rpartition(".")[2].lower()
        try:
            if ext == "toml":
                tree = tomllib.loads(text or "")
            elif ext in ("yaml", "yml"):
                import yaml

                tree = yaml.safe_load(text or "")
            else:
                tree = json.loads(text or "")
            return json.dumps(tree, ensure_ascii=False, default=str), None
        except Exception as e:  # the parsers raise errors of many kinds
            return None, f"{type(e).__name__}: {e}"[:500]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(p, t) for p, t in zip(b.column("rel_path").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("rel_path"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["rel_path", "json", "error"])

    return texts.select("rel_path", "text").mapInArrow(run, "rel_path string, json string, error string")


def keys_of(trees: DataFrame, json_col: str = "json", key: str = "rel_path") -> DataFrame:
    """key, name and kind of each top-level key of a JSON object."""
    each = trees.select(key, json_col, F.explode(F.json_object_keys(json_col)).alias("name"))
    value = F.to_json(F.try_variant_get(F.try_parse_json(json_col), F.concat(F.lit("$['"), "name", F.lit("']")), "variant"))
    return each.select(key, "name", X.value_kind(value).alias("kind"))


def dot_path(json_col: str, path: str):
    """The value at a dotted path (numbers are places in lists) of a JSON text, as text; null where there is none."""
    steps = "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("."))
    return F.get_json_object(json_col, f"${steps}")


def found_lines(texts: DataFrame, query: str, most_bytes: int = 8000) -> DataFrame:
    """rel_path, line_no and line of the lines that hold the query in whatever case, of each text up to the one that reaches the limit."""
    hits = files.lines(texts).filter(X.any_cell_contains([F.col("line")], query))
    return B.within_cap(hits, "rel_path", [F.col("line_no")], F.octet_length("line") + 1, most_bytes)


def found_rows(rows: DataFrame, query: str, order: list[str], most_bytes: int = 8000) -> DataFrame:
    """The rows of which some cell holds the query, up to the one that reaches the limit; cells are joined by bars."""
    shown = rows.filter(X.any_cell_contains([F.col(f"`{c}`") for c in rows.columns], query))
    size = F.octet_length(F.concat_ws(" | ", *[F.col(f"`{c}`").cast("string") for c in rows.columns])) + 1
    return B.within_cap(shown, None, [F.col(c) for c in order], size, most_bytes)


def outline(texts: DataFrame) -> DataFrame:
    """rel_path, line_no, end, level and title of the headings of Markdown texts."""
    rows = files.lines(texts)
    last = rows.groupBy("rel_path").agg(F.max("line_no").alias("__last"))
    return C.section_ends(C.headings(rows).join(last, "rel_path"), "rel_path", "line_no", "level", F.col("__last")).drop("__last")


def byte_range(texts: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """texts with first_byte and last_byte (exclusive) of their lines from start to end (from 1, both included)."""
    parts = F.split("text", "\n", -1)
    upto = lambda n: F.when(n > 0, F.octet_length(F.array_join(F.slice(parts, 1, n), "\n")) + 1).otherwise(0)
    return texts.withColumn("first_byte", upto(F.col(start) - 1)).withColumn("last_byte", F.least(upto(F.col(end)), F.octet_length("text")))

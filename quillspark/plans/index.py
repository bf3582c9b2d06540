"""The chunk index: cutting, vectors, refresh with counters, and when it must be made anew."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import relational as R
from ..operators import runs as U
from ..operators import symbols as S
from ..sources import files
from ..sources.scratch import Tables
from ..sources.versions import Versions

#: Texts up to so many bytes are one chunk; least and most lines of a chunk made of symbols.
WHOLE_BYTES, LEAST_LINES, MOST_LINES = 8192, 20, 80
WORD = re.compile(r"\w+")
EMPTY = "path string, version string, chunk int, first int, last int, symbols array<string>, vector array<float>, model string, chunk_lines int"


def chunks(texts: DataFrame, chunk_lines: int = 60) -> DataFrame:
    """rel_path, chunk (from 0), first, last (lines, from 1) and symbols (kind and name) of each text.

    A small text is one chunk. A text whose language has symbols is cut where
    they begin, following ones together while they reach over ``chunk_lines``
    (20 to 80) at most, what stands before the first as ``<preamble>``. Others
    are cut every ``chunk_lines`` lines.
    """
    most = min(max(chunk_lines, LEAST_LINES), MOST_LINES)
    n = F.size(F.split("text", "\n", -1))
    sized = texts.select("rel_path", "ext", "text", n.alias("n"))
    lines = S.code_lines(sized)
    defined = S.symbols(lines).select("rel_path", "line_no", F.concat_ws(" ", "kind", "name").alias("symbol"))
    small, large = sized.filter(F.octet_length("text") <= WHOLE_BYTES), sized.filter(F.octet_length("text") > WHOLE_BYTES)
    one = small.select("rel_path", F.lit(1).alias("first"), F.col("n").alias("last"))
    starts = defined.join(large.select("rel_path", "n"), "rel_path").select("rel_path", "n", "line_no").distinct()
    spans = R.territory(starts, "rel_path", "line_no", F.col("n")).select("rel_path", F.col("line_no").alias("low"), F.col("end").alias("high"))
    cut = U.line_groups(spans, "rel_path", "low", "high", most).select("rel_path", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))
    before = starts.groupBy("rel_path").agg(F.min("line_no").alias("m")).filter("m > 1").select("rel_path", F.lit(1).alias("first"), (F.col("m") - 1).cast("int").alias("last"))
    plain = large.join(starts.select("rel_path").distinct(), "rel_path", "left_anti")
    at = F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / chunk_lines).cast("int"))).alias("i")
    plain = plain.select("rel_path", "n", at).select("rel_path", (F.col("i") * chunk_lines + 1).alias("first"), F.least((F.col("i") + 1) * chunk_lines, "n").alias("last"))
    pieces = one.unionByName(cut).unionByName(plain).unionByName(before)
    named = pieces.join(defined, "rel_path", "left").filter("line_no IS NULL OR line_no BETWEEN first AND last")
    held = named.groupBy("rel_path", "first", "last").agg(F.array_sort(F.collect_list(F.when(F.col("symbol").isNotNull(), F.struct("line_no", "symbol")))).alias("s"))
    rows = pieces.join(held, ["rel_path", "first", "last"], "left")
    is_before = rows.join(before.withColumn("pre", F.lit(True)), ["rel_path", "first", "last"], "left")
    names = F.when(F.col("pre"), F.array(F.lit("<preamble>"))).otherwise(F.coalesce(F.transform("s", lambda x: x["symbol"]), F.array().cast("array<string>")))
    ranked = R.first_per(is_before.select("rel_path", "first", "last", names.alias("symbols")), ["rel_path"], [F.col("first")], 1 << 30)
    return ranked.select("rel_path", (F.col("rank") - 1).alias("chunk"), "first", "last", "symbols")


def chunk_texts(texts: DataFrame, cut: DataFrame) -> DataFrame:
    """cut with the text of each chunk."""
    own = F.array_join(F.slice(F.split("text", "\n", -1), F.col("first"), F.col("last") - F.col("first") + 1), "\n")
    return cut.join(texts.select("rel_path", "text"), "rel_path").withColumn("text", own)


def hashed_vectors(rows: DataFrame, dims: int = 256) -> DataFrame:
    """rows(text, ...) with vector: a bag of words hashed to ``dims`` cells, of length 1, for use where no embedding model is at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                cells = np.bincount([zlib.crc32(w.encode()) % dims for w in WORD.findall((text or "").lower())], minlength=dims).astype(np.float32)
                out.append(cells / (np.linalg.norm(cells) or 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float32()))], names=[*b.schema.names, "vector"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))


def load(spark: SparkSession, path: str) -> DataFrame:
    """The newest index at a path; an empty one where there is none or it has other columns."""
    return Versions(spark, path, EMPTY).read()


def usable(index: DataFrame, model: str, chunk_lines: int) -> DataFrame:
    """The index's rows that this model and these chunks made; of another make all go."""
    return index.filter((F.col("model") == model) & (F.col("chunk_lines") == chunk_lines))


def without_endings(index: DataFrame, endings: list[str]) -> DataFrame:
    """The index without the rows of files of these endings, to be made anew."""
    return index.filter(~F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(endings))


def refreshed(index: DataFrame, texts: DataFrame, embed: Callable[[DataFrame], DataFrame], model: str, chunk_lines: int = 60) -> DataFrame:
    """The index in step with texts(rel_path, ext, text): only new and changed files are cut and embedded anew.

    ``embed`` adds vector to rows with a text, which begins with ``passage: ``.
    """
    kept = usable(index, model, chunk_lines)
    now = texts.select(F.col("rel_path").alias("path"), F.md5("text").alias("version"))
    stale = now.join(kept.select("path", "version").distinct(), ["path", "version"], "left_anti")
    some = texts.join(stale.select(F.col("path").alias("rel_path")), "rel_path", "left_semi")
    cut = chunk_texts(some, chunks(some, chunk_lines))
    cut = embed(cut.withColumn("text", F.concat(F.lit("passage: "), "text")))
    made = cut.join(stale.withColumnRenamed("path", "rel_path"), "rel_path").select(
        F.col("rel_path").alias("path"), "version", "chunk", "first", "last", "symbols", "vector", F.lit(model).alias("model"), F.lit(chunk_lines).alias("chunk_lines"))
    same = kept.join(now, ["path", "version"], "left_semi").select(*made.columns)
    return same.unionByName(made)


def counters(statuses: DataFrame) -> DataFrame:
    """One row: added, updated, deleted and same of ``relational.changes``."""
    status = F.col("status")
    return statuses.agg(F.count_if(status == "new").alias("added"), F.count_if(status.isin("resized", "changed")).alias("updated"), F.count_if(status == "deleted").alias("deleted"), F.count_if(status == "same").alias("same"))


def save(index: DataFrame, path: str) -> int:
    """Makes index, which may be made from what ``load`` read there, the newest version at the path; jobs that read an older one go on."""
    return Versions(index.sparkSession, path, EMPTY).replace(index)


def kept_up(spark: SparkSession, path: str, texts: DataFrame, embed: Callable[[DataFrame], DataFrame], model: str, chunk_lines: int = 60) -> DataFrame:
    """Brings the index at a path in step with texts in place and returns its ``counters``; without a change nothing is written."""
    old = load(spark, path)
    known = old.select("path", "version", ((F.col("model") == model) & (F.col("chunk_lines") == chunk_lines)).alias("ours")).distinct().filter("ours")
    now = texts.select(F.col("rel_path").alias("path"), F.md5("text").alias("now"))
    status = F.when(F.col("version").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("version") == F.col("now"), "same").otherwise("changed")
    did = Tables(spark, "counters").put(counters(known.join(now, "path", "full").select(status.alias("status"))), "row")
    got = did.first()
    if got.added or got.updated or got.deleted or not old.filter(~((F.col("model") == model) & (F.col("chunk_lines") == chunk_lines))).isEmpty():
        save(refreshed(old, texts, embed, model, chunk_lines), path)
    return did


def indexable(found: DataFrame) -> DataFrame:
    """texts of a scan that an index takes: no zero bytes, broken UTF-8 mended."""
    return files.texts(found)

"""Exact deduplication against a persistent digest index (DataFrame operations only)."""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Scratch, documents, shuffle_partitions, text_of

#: Rows for each bucket of an index whose number of buckets is not given.
PER_BUCKET = 2_000_000


class DigestIndex:
    """Digests seen so far: a Parquet table bucketed and sorted by digest at a shared location.

    ``ingest`` finds the new digests of a batch by a sort-merge anti-join with
    the index, whose side needs no shuffle, and appends them under the batch's
    name. The table lives as long as its files: a later session opens the same
    location. Its name in the catalogue is made of the whole location.
    """

    def __init__(self, spark: SparkSession, location: str, buckets: int = 64):
        self.spark, self.location, self.buckets = spark, location.rstrip("/"), buckets
        self.name = "digest_index_" + hashlib.sha256(self.location.encode()).hexdigest()[:32]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.location}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, fresh: DataFrame) -> None:
        """Adds fresh(digest, keep_id, batch)."""
        (
            fresh.repartition(self.buckets, "digest")
            .write.format("parquet")
            .mode("append")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.name, path=self.location)
        )
        self.spark.catalog.refreshTable(self.name)

    def compacted(self, location: str, buckets: int | None = None) -> DigestIndex:
        """The index written anew at another location, one file a bucket, so that its order by digest is trusted again."""
        new = DigestIndex(self.spark, location, buckets or self.buckets)
        new.append(self.table())
        return new

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, batch: str | None = None) -> DataFrame:
        """One row per row of docs: row id, keep_id, group_size, kept, text_sha256 and the input row's place.

        Texts are equal when identical after each run of ASCII white space
        becomes one space; null counts as the empty text. Of the equal texts of
        the batch the row with the smallest id stays (null ids come last; of
        repeated rows with that id one stays), unless another batch had the
        text before: then none stays and keep_id is the id kept then. group_size
        counts the rows of this batch. An empty batch gives no rows. Other
        columns of docs are not read. The place is ``row_col``, a unique long,
        where docs has one.

        A batch that is ingested again under its name, as after a lost job,
        decides as it did before: its own digests count as new, and only those
        that are not yet stored are added. Without a name each batch is another.
        """
        batch = batch or uuid.uuid4().hex
        scratch = Scratch(self.spark, "exact-dedup")
        normal = F.regexp_replace(text_of(text_col), f"[{SPACE}]+", " ")
        rows = scratch.table(
            docs.select(
                F.col(id_col).cast("long").alias("doc_id"),
                F.unhex(F.sha2(normal, 256)).alias("digest"),
                (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
            ),
            "rows",
        )
        groups = scratch.table(
            rows.groupBy("digest")
            .agg(
                F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"),
                F.count(F.lit(1)).alias("group_size"),
            )
            .select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"),
            "groups",
        )
        others = self.table().filter(F.col("batch") != batch).select("digest").hint("merge")
        fresh = scratch.table(groups.join(others, "digest", "left_anti"), "fresh")
        own = self.table().filter(F.col("batch") == batch).select("digest").hint("merge")
        self.append(fresh.join(own, "digest", "left_anti").select("digest", "keep_id", F.lit(batch).alias("batch")))
        before = self.table().filter(F.col("batch") != batch).select("digest", F.col("keep_id").alias("known_id"))
        known = groups.select("digest", "group_size").join(before.hint("merge"), "digest", "left")
        firsts = fresh.select("digest", "keep_id", "keep_row")
        known = known.join(firsts, "digest", "left").select("digest", "group_size", F.coalesce("keep_id", "known_id").alias("keep_id"), "keep_row")
        known = scratch.table(known, "known")
        return rows.join(known, "digest").select(
            "doc_id",
            "keep_id",
            "group_size",
            F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
            "row",
        )


def exact_duplicates(docs: DataFrame, buckets: int | None = None, row_col: str | None = None, batches: int = 1) -> DataFrame:
    """docs fed to a new index in ``batches`` by order of id (equal shares of the span of ids; null ids in the last); group_size counts all.

    Columns and rules are those of ``DigestIndex.ingest``: as later batches have
    larger ids, the row with the smallest id stays whatever their number.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"))
    ends = docs.agg(F.count(F.lit(1)).alias("n"), F.min(F.col("doc_id").cast("long")).alias("low"), F.max(F.col("doc_id").cast("long")).alias("high")).first()
    index = DigestIndex(spark, f"{scratch.path}/index", buckets or max(shuffle_partitions(spark), -(-ends.n // PER_BUCKET)))
    if batches == 1 or ends.low is None:
        return index.ingest(own, row_col="row")
    own = scratch.table(own, "rows")  # numbered once, as each batch reads it
    cuts = [ends.low + (ends.high - ends.low + 1) * i // batches for i in range(1, batches)]
    parts = []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        inside = (F.lit(True) if low is None else F.col("doc_id") >= low) & (F.lit(True) if high is None else F.col("doc_id") < high)
        rows = own.filter(inside | F.col("doc_id").isNull() if high is None else inside)
        parts.append(index.ingest(rows, row_col="row", batch=str(len(parts))))
    every = reduce(DataFrame.unionByName, parts)
    sizes = every.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"))
    return every.drop("group_size").join(sizes, "text_sha256").select(*parts[0].columns)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir), batches=2).drop("row")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, documents, shuffle_partitions, text_of


class Rows:
    """Rows of the communication matrix: how many rows each unit of the input sends to each bin.

    The whole matrix is a multivariate hypergeometric draw (rows sum to the
    units' counts, columns to the bins' sizes, as under a uniform permutation of
    all rows). It is never made: the units are halved down a tree, and at each
    node what the left half takes of the node's room is drawn by a generator
    seeded with the node's place. Whoever asks for a unit walks down to it, by
    as many draws as the tree is deep, and sees the same numbers.
    """

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, seed: int):
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.seed, self.path = seed, [(0, len(counts), np.asarray(sizes, np.int64))]

    def row(self, unit: int) -> np.ndarray:
        while not self.path[-1][0] <= unit < self.path[-1][1]:
            self.path.pop()
        while self.path[-1][1] - self.path[-1][0] > 1:
            low, high, room = self.path[-1]
            mid = (low + high) // 2
            rng = np.random.default_rng([self.seed, low, high])
            left = rng.multivariate_hypergeometric(room, int(self.before[mid] - self.before[low]), method="marginals")
            self.path.append((low, mid, left) if unit < mid else (mid, high, room - left))
        return self.path[-1][2]


def even(n: int, parts: int) -> np.ndarray:
    """n in parts that differ by one at most, the larger first."""
    return n // parts + (np.arange(parts) < n % parts)


#: Rows that the draws of the matrix can hold (a bound of numpy's), rows of a unit of the input, and rows of a bin.
MOST_ROWS, PER_UNIT, PER_BIN = 999_999_999, 1 << 20, 100_000


def shuffle_into_shards(rows: DataFrame, shards: int = 8, seed: int = 29, rows_per_bin: int = PER_BIN, staged: bool = False, per_unit: int = PER_UNIT) -> DataFrame:
    """rows with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard), uniformly at random.

    Shard sizes differ by one row at most. A shard consists of bins of even
    size, each one task's work: of rows_per_bin rows, and as many as there are
    shuffle partitions at least. A unit is up to per_unit rows of one input
    file, in the file's order. Each unit deals its rows, permuted, to the bins
    by its row of the communication matrix (``Rows``); after the one exchange
    each bin is permuted again. A row's unit and place are its file and its
    number there, so that nothing depends on how Spark cuts files into tasks,
    or on which executors run them. Only the units' counts (one number each)
    reach the driver and the tasks.

    Input columns named shard or slot are replaced; internal names are chosen
    so that none clashes. An empty table gives no rows; fewer rows than shards
    leave the last shards empty; nulls and repeated rows are rows like others.
    rows are written first unless ``staged`` says that they are a plain scan of
    Parquet files. More than MOST_ROWS rows raise ValueError.
    """
    spark = rows.sparkSession
    if not staged:
        rows = Scratch(spark, "shards").table(rows, "rows")
    rows = rows.drop("shard", "slot")
    mark = "_"
    while any(c.startswith(mark) for c in rows.columns):
        mark += "_"
    file, at, bin_, order = (f"{mark}{x}" for x in ("file", "at", "bin", "order"))
    placed = rows.withColumns({file: F.col("_metadata.file_path"), at: F.col("_metadata.row_index")})
    seen = placed.groupBy(file, F.floor(F.col(at) / per_unit).alias("block")).count().collect()
    seen.sort(key=lambda r: (r[0], r[1]))
    counts = np.array([r[2] for r in seen], np.int64)
    total = int(counts.sum())
    if total > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows")
    per_shard = max(1, -(-total // (rows_per_bin * shards)), -(-shuffle_partitions(spark) // shards))
    sizes = np.concatenate([even(int(n), per_shard) for n in even(total, shards)])
    first = np.concatenate([np.cumsum(x) - x for x in sizes.reshape(shards, per_shard)])
    shared = spark.sparkContext.broadcast(({(r[0], r[1]): i for i, r in enumerate(seen)}, counts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, counts = shared.value
        matrix, last, to = Rows(counts, sizes, seed), None, np.array([], np.int32)
        for b in batches:
            place = b.column(at).to_numpy()
            bins = np.empty(len(place), np.int32)
            names = b.column(file).to_pylist()
            for i, (name, block) in enumerate(zip(names, (place // per_unit).tolist(), strict=True)):
                if (name, block) != last:
                    last, unit = (name, block), units[(name, block)]
                    to = np.random.default_rng([seed, unit]).permutation(np.repeat(np.arange(len(sizes), dtype=np.int32), matrix.row(unit)))
                bins[i] = to[place[i] % per_unit]
            kept = [n for n in b.schema.names if n not in (file, at, order)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(bins), b.column(order)], names=[*kept, bin_, order])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = -1, 0
        for b in batches:
            bins = b.column(bin_).to_numpy()
            start = np.flatnonzero(np.diff(bins, prepend=bins[0] - 1)) if len(bins) else np.array([], int)
            rank = np.arange(len(bins)) - np.repeat(start, np.diff(start, append=len(bins)))
            if len(bins) and bins[0] == last:
                head = start[1] if len(start) > 1 else len(bins)
                rank[:head] += done
            if len(bins):
                last, done = bins[-1], int(rank[-1]) + 1
            own = [pa.array((bins // per_shard).astype(np.int32)), pa.array(first[bins] + rank)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *own], names=[*b.schema.names[:-2], "shard", "slot"])

    fields = list(rows.schema.fields)
    placed = placed.withColumn(order, F.xxhash64(F.lit(seed), file, at))
    dealt = placed.mapInArrow(deal, T.StructType([*fields, T.StructField(bin_, T.IntegerType()), T.StructField(order, T.LongType())]))
    dealt = dealt.repartitionById(len(sizes), F.col(bin_)).sortWithinPartitions(bin_, order)
    return dealt.mapInArrow(place, T.StructType([*fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]))


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shuffle_into_shards(documents(spark, sf_dir).select("doc_id", "text"), staged=True)
    utf8 = text_of().cast("binary")
    return rows.select(
        "doc_id",
        (F.octet_length(utf8) + 1).cast("long").alias("size"),
        F.crc32(utf8).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

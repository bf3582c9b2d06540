"""Joins, windows and aggregates over keyed tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def changes(index: DataFrame, disk: DataFrame, key: str) -> DataFrame:
    """key and status of each side's rows (key, size, hash): new, deleted, resized, changed or same.

    Sizes are compared before hashes. A full outer join on the key; keys are unique on each side.
    """
    a, b = index.toDF(key, "size_a", "hash_a"), disk.toDF(key, "size_b", "hash_b")
    status = (
        F.when(F.col("in_a").isNull(), "new").when(F.col("in_b").isNull(), "deleted")
        .when(~F.col("size_a").eqNullSafe(F.col("size_b")), "resized").when(~F.col("hash_a").eqNullSafe(F.col("hash_b")), "changed").otherwise("same")
    )
    both = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), key, "full_outer")
    return both.select(key, status.alias("status"))


def longest_prefix(paths: DataFrame, owners: DataFrame, path: str, owner: str) -> DataFrame:
    """paths with the owner that is its longest ancestor by whole segments (itself too); no owner gives null.

    Each path's ancestors are exploded and met by an equi-join, in place of a nested loop over prefixes.
    """
    parts = F.split(path, "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    found = paths.select(path, F.explode(ancestors).alias(owner)).join(owners.select(owner).distinct(), owner)
    best = found.groupBy(path).agg(F.max_by(owner, F.length(owner)).alias(owner))
    return paths.join(best, path, "left")


def tightest_interval(points: DataFrame, spans: DataFrame, group: str, at: str, low: str, high: str, name: str, width: int = 1000) -> DataFrame:
    """points with the name of the span of its group that holds it and begins last (of ties the smallest name); null without one.

    Spans are exploded to the bins of ``width`` that they touch, and met by an
    equi-join on group and bin: a point meets the spans near it, not all of its
    group, and a hot group is dealt out by bins. Choose the width near the
    spans' usual length.
    """
    bins = F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))).alias("__bin")
    near = spans.filter(F.col(low) <= F.col(high)).select(group, low, high, name, bins)
    keys = points.select(group, at).distinct()
    held = keys.withColumn("__bin", F.floor(F.col(at) / width)).join(near, [group, "__bin"]).filter((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high)))
    best = held.groupBy(group, at).agg(F.min(F.struct((F.lit(0) - F.col(low)).alias("late"), name)).alias("best"))
    return points.join(best.select(group, at, F.col(f"best.{name}").alias(name)), [group, at], "left").select(*points.columns, name)


def territory(symbols: DataFrame, group: str, line: str, last: Column) -> DataFrame:
    """symbols with end: the line before the group's next symbol, or last."""
    after = F.lead(line).over(Window.partitionBy(group).orderBy(line))
    return symbols.withColumn("end", F.coalesce(after - 1, last))


def edge_weights(edges: DataFrame, source: str, target: str, weight: Column) -> DataFrame:
    """Sum of weights of each pair of different ends."""
    return edges.filter(F.col(source) != F.col(target)).groupBy(source, target).agg(F.sum(weight).alias("weight"))


def first_per(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def top(rows: DataFrame, score: str, tie: str, n: int) -> DataFrame:
    """The n best rows; ties by the smaller ``tie``."""
    return rows.orderBy(F.desc(score), F.asc(tie)).limit(n)

"""Runs of following spans that together reach over so many lines at most (DataFrame operations only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import Tables
from .packing import FOLD, in_ranges


def line_groups(spans: DataFrame, key: str, low: str, high: str, most: int, fold: int = FOLD) -> DataFrame:
    """key, first, last and n of runs of following spans that together reach over at most ``most`` lines.

    A span that would make its run too long starts the next run, alone if it is
    too long itself; spans follow each other by low, then high. Spans with a null
    are left out. The spans of a key with ``fold`` of them or fewer are folded
    as one array; those of larger keys go through ``doubled``.
    """
    own = spans.select(F.col(key).alias("k"), F.col(low).cast("long").alias("low"), F.col(high).cast("long").alias("high")).dropna()
    if own.groupBy("k").count().filter(F.col("count") > fold).isEmpty():
        return folded(own, most).withColumnRenamed("k", key)
    tables = Tables(own.sparkSession, "runs")
    laid = tables.put(in_ranges(own, [F.col(c) for c in ("k", "low", "high")]), "spans")
    counts = laid.groupBy("k").count()
    few, many = (laid.join(counts.filter(c).select("k"), "k") for c in (F.col("count") <= fold, F.col("count") > fold))
    return folded(few, most).unionByName(doubled(tables.put(many, "many"), most, tables)).withColumnRenamed("k", key)


def folded(rows: DataFrame, most: int) -> DataFrame:
    """k, first, last and n of the runs of rows(k, low, high), each key as one array."""
    each = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("spans"))
    nothing = F.struct(F.array().cast("array<struct<first:bigint,last:bigint,n:bigint>>").alias("done"), *[F.lit(0).cast("long").alias(c) for c in ("first", "last", "n")])

    def state(done: Column, first: Column, last: Column, n: Column) -> Column:
        return F.struct(done.alias("done"), first.alias("first"), last.alias("last"), n.alias("n"))

    def closed(s: Column) -> Column:
        return F.when(s["n"] > 0, F.concat(s["done"], F.array(F.struct(s["first"], s["last"], s["n"])))).otherwise(s["done"])

    def add(s: Column, x: Column) -> Column:
        last = F.greatest(s["last"], x["high"])
        goes_on = (s["n"] > 0) & (last - s["first"] < most)
        return F.when(goes_on, state(s["done"], s["first"], last, s["n"] + 1)).otherwise(state(closed(s), x["low"], x["high"], F.lit(1).cast("long")))

    return each.select("k", F.inline(F.aggregate("spans", nothing, add, closed)))


def running_max(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows(k, part, at, ...) with name: the largest value of the key's rows up to this one; rows at the same place see each other.

    Taken within each range of a key and lifted by what the ranges before
    hold, of which a key has as many as there are partitions at most.
    """
    ranges = rows.groupBy("k", "part").agg(F.max(value).alias("all"))
    before = F.max("all").over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    lift = ranges.select("k", "part", before.alias("__before"))
    own = F.max(value).over(Window.partitionBy("k", "part").orderBy("at"))
    return rows.withColumn("__own", own).join(lift, ["k", "part"]).withColumn(name, F.greatest("__own", "__before")).drop("__own", "__before")


def successors(rows: DataFrame, most: int, tables: Tables) -> DataFrame:
    """at and to: where the run that begins at each of rows(k, low, high, at, part) ends, as the place of the next run's first span; rows without such one are left out.

    The span at j ends the runs of all earlier spans whose low is high - most or
    less: those up to one place, which a search among the lows of the key
    finds. So the first span that ends the run of i is the smallest j whose
    place is i or later, a running minimum from the end. A span that is too
    long itself ends its own run, and the next one follows.
    """
    long_ = F.lit(None).cast("long")
    lows = rows.select("k", F.col("low").alias("v"), F.lit(0).alias("kind"), F.col("at").alias("i"), long_.alias("j"))
    asks = rows.select("k", (F.col("high") - most).alias("v"), F.lit(1).alias("kind"), long_.alias("i"), F.col("at").alias("j"))
    laid = tables.put(in_ranges(lows.unionByName(asks), [F.col(c) for c in ("k", "v", "kind")]), "asked")
    found = tables.put(running_max(laid, "i", "upto").filter("j IS NOT NULL AND upto IS NOT NULL").select("k", "j", "upto"), "found")
    ends = found.groupBy("k", F.least("upto", F.col("j") - 1).alias("i")).agg(F.min("j").alias("j"))
    places = rows.select("k", F.col("at").alias("i"), long_.alias("j"), F.lit(True).alias("own")).unionByName(ends.withColumn("own", F.lit(False)))
    back = places.select("k", "own", F.negative("i").alias("at"), F.negative(F.shiftright("i", 33)).alias("part"), F.negative("j").alias("j"))
    ended = running_max(tables.put(back, "places"), "j", "to").filter("own").select(F.negative("at").alias("at"), F.negative("to").alias("end"))
    within = F.lead("at").over(Window.partitionBy("k", "part").orderBy("at"))
    parts = rows.groupBy("k", "part").agg(F.min("at").alias("begin"))
    after = parts.select("k", "part", F.lead("begin").over(Window.partitionBy("k").orderBy("part")).alias("after"))
    too_long = rows.withColumn("within", within).join(after, ["k", "part"]).filter(F.col("high") - F.col("low") >= most)
    alone = too_long.select("at", F.coalesce("within", "after").alias("alone"))
    return ended.join(alone, "at", "left").select("at", F.coalesce("alone", "end").alias("to")).dropna()


def doubled(rows: DataFrame, most: int, tables: Tables) -> DataFrame:
    """k, first, last and n of the runs of rows(k, low, high, at, part), keys of any size.

    Which spans begin runs is what can be reached from a key's first span by
    ``successors``. Each round doubles the steps of the jumps and adds what
    they reach from all beginnings known so far, so that a key of r runs takes
    log r rounds; no task holds a key.
    """
    jumps = tables.put(successors(rows, most, tables), "jumps")
    begins, round_ = [tables.put(rows.groupBy("k").agg(F.min("at").alias("at")).select("at"), "begins")], 0
    while True:
        known = reduce(DataFrame.unionByName, begins)
        reached = tables.put(known.join(jumps, "at").select(F.col("to").alias("at")), f"reached-{round_}")
        if reached.isEmpty():
            break
        begins.append(reached)
        further = jumps.toDF("to", "further")
        jumps = tables.put(jumps.join(further, "to").select("at", F.col("further").alias("to")), f"jumps-{round_}")
        round_ += 1
    marked = tables.put(rows.join(known.withColumn("begin", F.col("at")), "at", "left"), "marked")
    runs = running_max(marked, "begin", "run").groupBy("k", "run")
    return runs.agg(F.min("low").alias("first"), F.max("high").alias("last"), F.count(F.lit(1)).alias("n")).drop("run")

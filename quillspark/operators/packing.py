"""Greedy packing of ordered rows into budgets, in rounds of longest fitting prefixes (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import Tables


def in_ranges(rows: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """rows with at, a number that ascends in the order of the keys, and part, the range of rows that it is in.

    Rows are dealt by ranges of all keys, so that a group that holds most rows
    takes many ranges.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    return numbered.withColumn("part", F.shiftright("at", 33))


def prefix_sums(rows: DataFrame, group: str, size: str) -> DataFrame:
    """rows(group, part, at, size, ...) with upto: the sum of the group's sizes in order, the row's own included.

    Sums are taken within the ranges of each group and shifted by those of the
    ranges before, of which a group has as many as there are partitions at most.
    """
    ranges = rows.groupBy(group, "part").agg(F.sum(size).alias("all"))
    before = F.sum("all").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = ranges.select(group, "part", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.sum(size).over(Window.partitionBy(group, "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    shift = shift.toDF("of", "of_part", "before")
    both = rows.withColumn("own", own).join(shift, F.col(group).eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    return both.withColumn("upto", F.col("own") + F.col("before")).drop("own", "before", "of", "of_part")


def running(rows: DataFrame, group: Column, order: Sequence[Column], size: Column) -> DataFrame:
    """row (all columns of rows), s (the size) and upto, the sum of the group's sizes in order up to the row, its own included; null is a group too.

    Rows are laid into ranges of the order and written once, so that a group
    that holds most rows is summed by many tasks. Of rows that the order does
    not tell apart any may come first.
    """
    own = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), group.alias("g"), size.cast("long").alias("s"), *[c.alias(f"o{i}") for i, c in enumerate(order)])
    laid = in_ranges(own, [F.col("g"), *[F.col(f"o{i}") for i in range(len(order))]]).select("row", "g", "s", "at", "part")
    return prefix_sums(Tables(rows.sparkSession, "running").put(laid, "rows"), "g", "s").select("row", "s", "upto")


def within_cap(rows: DataFrame, group: str | None, order: Sequence[Column], size: Column, cap: int) -> DataFrame:
    """Rows of each group (of all, where none is named) in order up to the one that reaches the cap: kept while the sum before is below it."""
    return running(rows, F.col(group) if group else F.lit(0), order, size).filter(F.col("upto") - F.col("s") < cap).select("row.*")


def within_budget(rows: DataFrame, group: str | None, order: Sequence[Column], size: Column, budget: int) -> DataFrame:
    """Rows of each group in order up to the first that would break the budget; that one and all later ones are left out. Sizes are not negative."""
    return running(rows, F.col(group) if group else F.lit(0), order, size).filter(F.col("upto") <= budget).select("row.*")


#: Rows of a group that one fold over an array may hold.
FOLD = 512


def folded(rows: DataFrame) -> DataFrame:
    """g, k and s of the rows(g, k, s, room, at) that each group takes in order, group by group as one array."""
    each = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("at", "s", "k"))).alias("rows"), F.max("room").alias("room"))
    kind = each.schema["rows"].dataType.simpleString()
    nothing = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(kind).alias("kept"))

    def take(state: Column, x: Column) -> Column:
        more = F.struct((state["used"] + x["s"]).alias("used"), F.concat(state["kept"], F.array(x)).alias("kept"))
        return F.when(state["used"] + x["s"] <= F.col("room"), more).otherwise(state)

    return each.select("g", F.explode(F.aggregate("rows", nothing, take)["kept"]).alias("x")).select("g", "x.k", "x.s")


def taken_in_rounds(own: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """g, k and s of the rows(g, k, s, room) that each group takes in the order of the keys, of groups of any size (see ``pack_greedy``)."""
    tables = Tables(own.sparkSession, "packing")
    laid = in_ranges(own, [F.col("g"), *keys])
    left, taken, round_ = tables.put(laid.select("g", "k", "s", "room", "at", "part"), "rows"), [], 0
    while True:
        counts = left.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        taken.append(folded(left.join(counts.filter(F.col("n") <= FOLD), "g")))
        many = left.join(counts.filter(F.col("n") > FOLD).select("g"), "g")
        summed = tables.put(prefix_sums(many, "g", "s"), f"round-{round_}")
        if summed.isEmpty():
            return reduce(DataFrame.unionByName, taken)
        fits = F.col("upto") <= F.col("room")
        taken.append(summed.filter(fits).select("g", "k", "s"))
        over = summed.groupBy("g").agg(F.coalesce(F.sum(F.when(fits, F.col("s"))), F.lit(0)).alias("took"), F.min(F.when(~fits, F.col("at"))).alias("first")).filter("first IS NOT NULL")
        rest = summed.drop("upto").join(over, "g").filter("at > first AND s <= room - took")
        left = tables.put(rest.select("g", "k", "s", (F.col("room") - F.col("took")).alias("room"), "at", "part"), f"left-{round_}")
        round_ += 1


def pack_greedy(rows: DataFrame, group: str, order: Sequence[str | Column], size: str, key: str, budget: int | str, fixed: int = 0) -> DataFrame:
    """group, used (all that is taken), n_taken and key of the rows taken in order while they fit the budget; a row too large is skipped and later ones may still fit.

    ``budget`` is a number or names a column that is the same for all rows of a
    group; ``fixed`` is taken before the first row. Ties of the order are broken
    by the key. Rows of no group, and those larger than the whole budget, are
    left out; sizes are not negative.

    What has been taken decides what fits next. A group of FOLD rows or fewer is
    folded as one array. In a larger one each round takes the longest prefix of
    its rows that fits what is left; the first row that does not is dropped,
    and with it all rows larger than what is left then, until FOLD rows or fewer
    remain. Rows lie in ranges of the order (``in_ranges``), so that no task
    holds a large group; each round reads what the one before has left.
    """
    room = (F.col(budget) if isinstance(budget, str) else F.lit(budget)).cast("long") - fixed
    own = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(size).cast("long").alias("s"), room.alias("room"), *[(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)])
    own = own.filter(F.col("g").isNotNull() & (F.col("s") <= F.col("room")))
    keys = [*[F.col(f"o{i}") for i in range(len(order))], F.col("k")]
    small = own.groupBy("g").count().filter(F.col("count") > FOLD).isEmpty()
    all_ = folded(own.withColumn("at", F.struct(*keys))) if small else taken_in_rounds(own, keys)
    sums = all_.groupBy("g").agg((F.sum("s") + fixed).cast("long").alias("used"), F.count(F.lit(1)).cast("int").alias("n_taken"))
    return all_.join(sums, "g").select(F.col("g").alias(group), "used", "n_taken", F.col("k").alias(key))

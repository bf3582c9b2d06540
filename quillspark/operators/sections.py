"""Sections, choice among candidates, and upkeep of an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEVELS = 6


def headings(lines: DataFrame, key: str = "rel_path") -> DataFrame:
    """key, line_no, level and title of Markdown headings in lines(key, line_no, line); those within fences do not count."""
    fences = F.sum(F.col("line").rlike(r"^\s*```").cast("int")).over(Window.partitionBy(key).orderBy("line_no"))
    open_ = lines.withColumn("__open", F.coalesce(fences, F.lit(0)) % 2 == 1)
    found = open_.filter(~F.col("__open") & F.col("line").rlike(r"^#{1,6}\s+\S"))
    level, title = F.length(F.regexp_extract("line", "^#+", 0)), F.regexp_replace("line", r"^#+\s+|\s+#*\s*$", "")
    return found.select(key, "line_no", level.alias("level"), title.alias("title"))


def section_ends(heads: DataFrame, key: str, at: str, level: str, last: Column) -> DataFrame:
    """heads with end: one before the key's next heading of the same or a higher level, or last.

    One window over the key's headings holds, for each level, the next heading
    of that level or above; a heading takes the one of its own level. Headings
    at the same place do not end each other.
    """
    after = Window.partitionBy(key).orderBy(F.desc(at)).rangeBetween(Window.unboundedPreceding, -1)  # from the end, so that each row adds to one sum
    nexts = [F.min(F.when(F.col(level) <= n, F.col(at))).over(after) for n in range(1, LEVELS + 1)]
    return heads.withColumn("__next", F.element_at(F.array(*nexts), F.col(level).cast("int"))).withColumn("end", F.coalesce(F.col("__next") - 1, last)).drop("__next")


def resolve(rows: DataFrame, candidates: Column, known: DataFrame, name: str) -> DataFrame:
    """rows with name: the first of their candidates that known(name) has, null if it has none.

    Candidates are exploded with their rank and met by an equi-join; rows keep
    their number, repeated ones too.
    """
    asked = rows.select(*rows.columns, candidates.alias("__all"))
    each = asked.select(F.explode(F.array_distinct("__all")).alias(name), F.col("__all")).distinct()
    found = each.join(known.select(name).distinct(), name).groupBy("__all").agg(F.min_by(name, F.array_position("__all", F.col(name))).alias(name))
    return asked.join(found, "__all", "left").drop("__all")


def refresh(index: DataFrame, disk: DataFrame, key: str, version: str) -> DataFrame:
    """index brought in step with disk, both (key, version, ...) of the same columns: rows of keys that disk lacks or
    holds in another version go, disk's rows of new and changed keys come. Keys are unique on disk, an index may hold
    several rows (chunks) of a key."""
    same = index.join(disk.select(key, version), [key, version], "left_semi")
    new = disk.join(index.select(key, version).distinct(), [key, version], "left_anti")
    return same.select(*index.columns).unionByName(new.select(*index.columns))

"""Checkpoints of symbols: saved versions by namespace and tag, listed, compared and deleted."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import normal_path
from ..operators.relational import first_per
from ..sources.versions import Versions

SCHEMA = "tag string, path string, symbol string, code string, line_no int, line_end int, created_unix_ms long, namespace string"
#: The tag that stands for the present state.
LIVE = "__live__"
#: What does not count at the ends of a code.
BLANKS = " \t\r\n"


def checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """All checkpoints, newest first; those of JSON files that cannot be read are left out, a missing folder has none."""
    try:
        rows = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)
    needed = F.col("tag").isNotNull() & F.col("symbol").isNotNull() & F.col("code").isNotNull()
    return rows.filter(needed).withColumn("path", normal_path(F.col("path"))).orderBy(F.desc("created_unix_ms"), "tag", "symbol")


def save(rows: DataFrame, folder: str, namespace: str, tag: str) -> None:
    """Adds rows(path, symbol, code, line_no, line_end) as checkpoints of the present time; Spark's commit makes them visible at once."""
    if tag == LIVE or not tag.strip():
        raise ValueError("not a tag")
    now = F.unix_millis(F.current_timestamp())
    own = rows.select(F.lit(tag).alias("tag"), normal_path(F.col("path")).alias("path"), "symbol", "code", "line_no", "line_end", now.alias("created_unix_ms"), F.lit(namespace).alias("namespace"))
    own.write.mode("append").partitionBy("namespace").json(folder)


def meant(symbol: str | None = None, tag: str | None = None, path: str | None = None, namespace: str | None = None) -> Column:
    """Rows of exactly this symbol, tag, path and namespace, as far as given."""
    out = F.lit(True)
    for name, value in (("symbol", symbol), ("tag", tag), ("namespace", namespace)):
        if value is not None:
            out &= F.col(name) == value
    return out & (F.col("path") == normal_path(F.lit(path))) if path is not None else out


def listing(rows: DataFrame, keys: tuple[str, ...] = ("namespace", "tag"), newest: Column | None = None, key: str = "symbol", most: int = 50) -> DataFrame:
    """keys, rank, key of the ``most`` newest of each tag, and how many more it has."""
    order = [F.desc("created_unix_ms") if newest is None else newest, F.col(key)]
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return first_per(rows, list(keys), order, most).join(n, list(keys)).select(*keys, "rank", key, F.greatest(F.col("n") - most, F.lit(0)).alias("more"))


def compared(rows: DataFrame, a: str, b: str, symbol: str, path: str | None = None, live: DataFrame | None = None) -> DataFrame:
    """symbol, path_a, path_b, code_a, code_b and same (without blanks at the ends) of two tags' checkpoints of a symbol.

    ``live``(symbol, path, code) is the present state, which the tag LIVE means.
    Raises LookupError where a tag has none, or several (named, ten at most).
    """
    sides = []
    for tag in (a, b):
        side = live.withColumn("tag", F.lit(LIVE)) if tag == LIVE and live is not None else rows
        found = side.filter(meant(symbol, tag, path)).select("path", "code").limit(11)
        got = found.collect()  # 11 rows at most
        if len(got) != 1:
            raise LookupError(f"{symbol} at {tag}: " + ("none" if not got else "several: " + ", ".join(sorted(str(r.path) for r in got)[:10])))
        sides.append(found)
    left, right = sides[0].toDF("path_a", "code_a"), sides[1].toDF("path_b", "code_b")
    return left.crossJoin(right).select(F.lit(symbol).alias("symbol"), "*", (F.btrim("code_a", F.lit(BLANKS)) == F.btrim("code_b", F.lit(BLANKS))).alias("same"))  # one row each


def deleted(rows: DataFrame, symbol: str | None = None, tag: str | None = None, path: str | None = None, namespace: str | None = None) -> DataFrame:
    """The checkpoints that stay when all that are ``meant`` go; a namespace alone clears it, nothing at all is an error."""
    if symbol is tag is path is namespace is None:
        raise ValueError("nothing says what to delete")
    return rows.filter(~F.coalesce(meant(symbol, tag, path, namespace), F.lit(False)))


def delete(table: Versions, **what: str | None) -> int:
    """Rewrites a table of checkpoints without those that are ``meant`` (see ``deleted``) and returns how many went; jobs that read it go on."""
    old = table.read()
    stays = deleted(old, **what)
    n = old.count() - stays.count()
    if n:
        table.replace(stays)
    return n


def versions(rows: DataFrame) -> DataFrame:
    """rows with changed: whether the code differs from the version before of the same symbol and path."""
    before = F.lag(F.btrim("code", F.lit(BLANKS))).over(Window.partitionBy("namespace", "path", "symbol").orderBy("created_unix_ms", "tag"))
    return rows.withColumn("changed", ~before.eqNullSafe(F.btrim("code", F.lit(BLANKS))))

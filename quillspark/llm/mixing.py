"""Mixing sources to target weights (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, documents, shuffle_partitions, word_count

#: Bits of the digest that seed a document's draw; a double holds them exactly.
DRAW_BITS = 52


def ranked_sources(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """source, source_size and place: rank of the source by code point, null last, from 0.

    Rows are dealt by ranges, ranked in each range and shifted by the counts of
    the ranges before; only those counts (one per partition) meet in one task.
    """
    spark = sizes.sparkSession
    key = [F.col("source").isNull(), F.col("source")]
    totals = scratch.table(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "totals")
    dealt = scratch.table(
        totals.repartitionByRange(shuffle_partitions(spark), *key).withColumn("part", F.spark_partition_id()), "dealt"
    )
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*key))
    return dealt.withColumn("within", within).join(shift, "part").select("source", "source_size", (F.col("shift") + F.col("within") - 1).alias("place"))


def targets(sources: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """Adds target: the share of all words by weight, at most ``most`` times the source's size.

    A source reaches its cap when the common level (words per unit of weight)
    exceeds cap / weight. The level only rises as capped sources hand on their
    excess, so that it is found by repeated sums over the sources, each of
    which sends one row to the driver; a sum that caps no more sources ends it.
    """
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    rows = sources.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    left, weight, capped = total, rows.agg(F.sum("w")).first()[0] or 0, -1
    while True:
        full = F.col("cap") * F.lit(int(weight)) <= F.lit(int(left)) * F.col("w") if weight else F.lit(True)
        got = rows.agg(
            F.sum(F.when(full, F.col("cap"))).alias("held"), F.sum(F.when(~full, F.col("w"))).alias("w"), F.count_if(full).alias("n")
        ).first()
        if got.n == capped or not got.w:
            break
        left, weight, capped = total - (got.held or 0), got.w, got.n
    share = (F.col("w") * F.lit(int(left))).cast("double") / F.lit(float(weight or 1))
    return rows.select("source", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(share).alias("target"))


def draw(id_col: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone (null id: as the empty string)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("long").cast("double") / float(1 << DRAW_BITS)


def with_copies(docs: DataFrame, weights: Sequence[int], most: int, seed: int) -> DataFrame:
    """docs with __id, __size, __source_size, __target, __rate and __copies."""
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.table(docs.select(F.col("source").cast("string").alias("source"), word_count().alias("size")), "sizes")
    mix = targets(scratch.table(ranked_sources(sizes, scratch), "sources"), weights, most)
    mix = scratch.table(mix, "targets").toDF("__of", "__source_size", "__target")
    rows = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__source": F.col("source").cast("string"), "__size": word_count()})
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(0.0)
    more = (draw("__id", seed) < F.col("__rate") - F.floor("__rate")).cast("long")
    joined = rows.join(mix, F.col("__source").eqNullSafe(F.col("__of")))
    return joined.withColumn("__rate", rate).withColumn("__copies", F.floor("__rate") + more)


def plan_mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: int = 17) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, rate, copies.

    size is the number of words (null text: 0). Sources are ordered by code
    point, null last, and weigh ``weights``, repeating. rate = target /
    source_size; a document gets floor(rate) copies and one more where its
    hash-seeded draw is below the fraction, so reruns agree and repeated rows
    (same id) get the same number. Sources without words have rate 0. An empty
    table gives no rows. Other columns of docs are not read.
    """
    names = ("doc_id", "size", "source_size", "target", "rate", "copies")
    planned = with_copies(docs.select("doc_id", "text", "source"), weights, most, seed)
    return planned.select("__id", *[f"__{c}" for c in names[1:]]).toDF(*names)


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: int = 17) -> DataFrame:
    """The mixture itself: every row of docs, with all its columns, as often as ``plan_mix`` says."""
    own = [f"c{i}" for i in range(len(docs.columns))]  # names that cannot meet those of the work
    place = {c: i for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*own).withColumns({c: F.col(own[place[c]]) for c in ("doc_id", "text", "source")})
    again = F.explode(F.array_repeat(F.lit(True), F.col("__copies").cast("int"))).alias("again")
    copies = with_copies(rows, weights, most, seed).filter("__copies > 0").select(*own, again)
    return copies.select(*own).toDF(*docs.columns)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_mix(documents(spark, sf_dir))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, source_size, 3 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)
), o AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS held, sum(w) OVER rest AS weight, sum(source_size) OVER () AS total
  FROM s
  WINDOW before AS (ORDER BY cap::DOUBLE / w, source_size, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY cap::DOUBLE / w, source_size, w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT arg_min((total - held)::BIGINT, held) AS num, arg_min(weight::BIGINT, held) AS den
  FROM o WHERE cap * weight > (total - held) * w
), t AS (
  SELECT source, source_size,
         CASE WHEN den IS NULL OR cap * den <= num * w THEN cap::DOUBLE ELSE (w * num)::DOUBLE / den::DOUBLE END AS target
  FROM s CROSS JOIN level
), r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate,
         ('0x' || substr(md5('17:' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, ((floor(rate) + (u < rate - floor(rate))::INT) * size)::BIGINT AS taken FROM r
"""

"""Ranked lexical search by dense blocked matrix products with exact integer scores."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, documents, text_of

#: Maximal runs of digits, Latin letters and whatever is beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: In UTF-8 the same: other ASCII becomes a blank, capitals small.
FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Items and (item, term) pairs of a block on average; documents and terms of a tile; buckets that rank an item's candidates first.
BLOCK_ITEMS, BLOCK_PAIRS, TILE_DOCS, TILE_TERMS, BUCKETS = 256, 65_536, 1024, 2048, 64
#: Every impact is below this, and every partial sum of a tile must stay below 2^53, where doubles are exact integers.
IMPACT, EXACT = 1_000_000, 1 << 53
COUNTED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.LongType()))])
SCORED = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term and n of items(item_id, text); rows that share an id (a null one too) are one item with the terms of all."""
    term = F.explode(F.regexp_extract_all(F.translate(text_of(), UPPER, LOWER), F.lit(TERM), 0)).alias("term")
    return items.select("item_id", term).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("n"))


def counted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms of the whole text) and, of the terms that the vocabulary has, their places and counts; texts without terms are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(shared.value)}
        for b in batches:
            kept, sizes, terms, counts, ends = [], [], [], [], [0]
            for row, text in enumerate(b.column(1).to_pylist()):
                words = text.translate(FOLD).split()
                if words:
                    at, n = np.unique(np.fromiter((place[w] for w in words if w in place), np.int32), return_counts=True)
                    kept.append(row)
                    sizes.append(len(words))
                    terms.append(at)
                    counts.append(n)
                    ends.append(ends[-1] + len(at))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*x, np.array([], kind)]).astype(kind))) for x, kind in ((terms, np.int32), (counts, np.int64))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), *lists], names=COUNTED.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text")).mapInArrow(run, COUNTED)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def vocabulary_tiles(items: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_items: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The weights (item, term, weight; one row a pair) cut into tiles of terms: columns, and item, column and weight of each cell.

    A tile has TILE_TERMS columns at most, and no item's weights in it times
    IMPACT reach EXACT. A weight too large for that is written as a sum over
    several columns of the same term.
    """
    most = (EXACT - 1) // IMPACT
    tiles, columns, cells, held = [], [], [], np.zeros(n_items, np.int64)

    def close() -> None:
        if columns:
            i, c, w = (np.concatenate(x) for x in zip(*cells, strict=True))
            tiles.append((np.array(columns), i, c, w.astype(np.float64)))
        columns.clear()
        cells.clear()
        held[:] = 0

    order = np.argsort(terms, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(terms[order])) + 1) if len(order) else []:
        left = weights[part].astype(np.int64)
        while left.any():
            some = left > 0
            now = np.minimum(left, most)
            if len(columns) == TILE_TERMS or (held[items[part]] + now > most).any():
                close()
            held[items[part]] += now
            cells.append((items[part][some], np.full(int(some.sum()), len(columns)), now[some]))
            columns.append(int(terms[part[0]]))
            left = left - now
    close()
    return tiles


def best(item: np.ndarray, doc: np.ndarray, gone: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each item's k best: the highest scores, of equal ones the smallest ids, those without an id last."""
    order = np.lexsort((doc, gone, -score, item))
    start = np.flatnonzero(np.diff(item[order], prepend=-1))
    return order[np.arange(len(order)) - np.repeat(start, np.diff(start, append=len(order))) < k]


def scored(rows: DataFrame, pairs: list[tuple[int, int, int]], n_items: int, n_terms: int, n_docs: int, length: int, k: int) -> DataFrame:
    """item, doc_id and score of the k best documents of each item among each task's ``counted`` rows; zero scores are left out.

    Documents are laid out in tiles of impacts, float64, which a BLAS product
    meets with the tiles of the items' weights; whole numbers below 2^53 come
    out exact whatever the order of the sums, and tiles add up in int64. What
    is kept of a tile are all scores that reach the item's k-th best so far, so
    that ties are decided by id and never by place.
    """
    shared = rows.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = vocabulary_tiles(*(np.array(x, np.int64) for x in zip(*shared.value, strict=True)), n_items)
        kept = tuple(np.array([], x) for x in (np.int64, np.int64, bool, np.int64))
        floor = np.ones(n_items, np.int64)
        for b in batches:
            for low in range(0, b.num_rows, TILE_DOCS):
                kept = tile(b.slice(low, TILE_DOCS), tiles, kept, floor)
        item, doc, gone, score = kept
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(doc, mask=gone), pa.array(score)], names=SCORED.names)

    def tile(b: pa.RecordBatch, tiles: list, kept: tuple, floor: np.ndarray) -> tuple:
        n, lists = b.column("n").to_numpy(), b.column("terms")
        row = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy())
        term, tf = lists.flatten().to_numpy(), b.column("tf").flatten().to_numpy()
        if 75 * int(n.max(initial=0)) * n_docs >= 1 << 63:
            m = np.array([25 + (75 * int(x) * n_docs) // length for x in n], np.int64)
        else:
            m = 25 + (75 * n * n_docs) // length
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
        scores, column = np.zeros((n_items, len(n)), np.int64), np.full(n_terms, -1)
        for columns, i, c, w in tiles:
            weights, impacts = np.zeros((n_items, len(columns))), np.zeros((len(columns), len(n)))
            weights[i, c] = w
            fresh = np.diff(columns, prepend=-1) != 0
            column[columns[fresh]] = np.flatnonzero(fresh)
            on = column[term] >= 0
            impacts[column[term[on]], row[on]] = impact[on]
            again = np.flatnonzero(~fresh)  # further columns of a term that has several
            impacts[again] = impacts[column[columns[again]]]
            column[columns] = -1
            scores += (weights @ impacts).astype(np.int64)
        i, d = np.nonzero(scores >= floor[:, None])
        ids = b.column("doc_id")
        doc, gone = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        kept = tuple(np.concatenate(x) for x in zip(kept, (i, doc[d], gone[d], scores[i, d]), strict=True))
        chosen = best(*kept, k)
        kept = tuple(x[chosen] for x in kept)
        full = np.flatnonzero(np.bincount(kept[0], minlength=n_items) == k)
        last = np.searchsorted(kept[0], full, "right") - 1  # each item's rows stand from the best to the k-th
        floor[full] = kept[3][last]
        return kept

    return rows.filter(F.size("terms") > 0).mapInArrow(run, SCORED)


def first_by_score(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item, ranked from 1: first in buckets of tasks, then of what these leave."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = rows.withColumn("part", F.spark_partition_id() % BUCKETS)
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= k)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k).drop("part")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, block_items: int = BLOCK_ITEMS, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's k best documents with a score above 0.

    The scores are those of op11's contract: of each of the item's terms,
    repeats included, weight times impact, in whole numbers. Equal scores rank
    by doc_id, a null id last; rows of docs that share an id are documents each,
    rows of items that share one are one item. Null and empty texts have no
    terms, and neither match nor count. Only doc_id, item_id and text are read.

    Items are dealt by hash into blocks of about block_items items and
    block_pairs (item, term) pairs; a block's vocabulary and weights reach all
    tasks, and each block passes over all documents (counts of its vocabulary,
    which are written; document frequencies; scores). An item is never split, so
    that its own terms must fit in memory. Of the documents each task sends k
    rows an item at most.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "ranking")
    pairs = scratch.table(item_terms(items), "items")
    got = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct(F.struct("item_id")).alias("items")).first()
    blocks = max(1, -(-got.items // block_items), -(-got.pairs // block_pairs))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    tops = []
    for block in range(blocks if got.pairs else 0):
        own = pairs.filter(F.col("block") == block).select("item_id", F.col("term").cast("binary").alias("term"), "n").collect()
        names = sorted({(x.item_id is not None, x.item_id) for x in own})
        vocabulary = sorted({bytes(x.term) for x in own})
        item, term = {x[1]: i for i, x in enumerate(names)}, {t: i for i, t in enumerate(vocabulary)}
        rows = scratch.table(counted(docs, vocabulary), f"counted-{block}")
        n_docs, length = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # the block's vocabulary at most
        cells = [(item[x.item_id], t, x.n * weight(n_docs, df[t])) for x in own if (t := term[bytes(x.term)]) in df]
        if not cells:
            continue
        top = first_by_score(scored(rows, cells, len(names), len(vocabulary), n_docs, length, k), k)
        known = spark.createDataFrame([(i, x[1]) for i, x in enumerate(names)], T.StructType([T.StructField("item", T.IntegerType()), pairs.schema["item_id"]]))
        tops.append(scratch.table(top.join(F.broadcast(known), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), f"top-{block}"))
        scratch.drop(f"counted-{block}")
    if not tops:
        kinds = [pairs.schema["item_id"], T.StructField("rank", T.IntegerType()), *SCORED.fields[1:]]
        return spark.createDataFrame([], T.StructType(kinds))
    return reduce(DataFrame.unionByName, tops)


def op11_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = rf"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM documents
), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
l AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM c GROUP BY doc_id),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM l),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM c CROSS JOIN g GROUP BY term, docs),
i AS (SELECT item_id, term, count(*) AS times FROM (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark) GROUP BY ALL),
s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))))::BIGINT AS score
  FROM i JOIN w USING (term) JOIN c USING (term) JOIN l USING (doc_id) CROSS JOIN g GROUP BY item_id, doc_id
), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10
"""

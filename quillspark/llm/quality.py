"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_of

#: Rows of labels that the model is fitted on at most (those with the smallest hash of their id); bounds the fit on the driver.
MOST_LABELLED = 6_000
#: Features are hashed to so many buckets; so many that rare words of long texts seldom meet a weighted one.
HASH_BITS = 26
#: A feature is used if so many rows of the sample have it.
LEAST_ROWS = 8
#: Grades: 0 toxic, 1 poor, 2 good.
GRADES = 3
#: A document is selected where P(grade >= 2) is at least this.
SELECT = 0.3

EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def bucket(feature: str) -> int:
    data = feature.encode("utf-8", "surrogatepass")
    return (zlib.crc32(data) << 8 ^ zlib.adler32(data)) & ((1 << HASH_BITS) - 1)


class Buckets(dict):
    """Bucket of a word without the marks around it, in small letters; emptied at a size, which bounds memory only."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        plain = EDGES.sub("", word).lower()
        self[word] = got = bucket(plain) if plain else -1
        return got


def shape(text: str, words: list[str], distinct: int) -> list[str]:
    """Features of the text's build: shares of capitals, marks, repeated words and such, in coarse steps."""
    n, w = max(len(text), 1), max(len(words), 1)
    marks = sum(map(text.count, "!?#*|<>{}[]=\\/_~^"))
    upper = sum(map(str.isupper, words))
    step = lambda x, *at: sum(x >= a for a in at)
    return [
        f"\tmarks{step(marks / n, 0.005, 0.02, 0.05)}",
        f"\tupper{step(upper / w, 0.05, 0.2, 0.5)}",
        f"\tdistinct{step(distinct / w / min(1.0, (100 / w) ** 0.3), 0.15, 0.3, 0.45, 0.6)}",
        f"\twords{step(w, 3, 10, 30, 100, 300, 1000)}",
        f"\tlength{step(n / w, 3.5, 5, 7, 9, 14)}",
        f"\tdigits{step(sum(map(text.count, '0123456789')) / n, 0.02, 0.1, 0.3)}",
    ]


def features(text: str, memo: Buckets) -> list[int]:
    """Distinct buckets of a text's words and shape."""
    words = text.split()
    distinct = set(words)
    found = set(map(memo.__getitem__, distinct))
    found.discard(-1)
    found.update(map(memo.__getitem__, map(bucket_name, shape(text, words, len(distinct)))))
    return list(found)


def bucket_name(name: str) -> str:
    return "\x00" + name


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class CumulativeLink:
    """P(grade >= k) = sigmoid(w . x - threshold_k): one weight per bucket for all grades, thresholds in order."""

    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        return sigmoid(score[:, None] - self.thresholds[None, :])


def fit(rows: Sequence[tuple[Sequence[int], int]], grades: int = GRADES, least: int = LEAST_ROWS, l2: float = 2.0, steps: int = 200) -> CumulativeLink:
    """Maximum posterior fit by Adam over (buckets, grade) rows; without rows of two grades all weights are 0.

    Thresholds are a start and positive gaps, so that their order always holds.
    """
    sizes = np.array([len(x) for x, _ in rows], np.int64)
    flat = np.fromiter((i for x, _ in rows for i in x), np.int64, int(sizes.sum()))
    y = np.array([g for _, g in rows], np.int64)
    known, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    used = n >= least
    place = np.cumsum(used) - 1
    keep = used[at]
    row, col, known = np.repeat(np.arange(len(rows)), sizes)[keep], place[at[keep]], known[used]
    share = np.array([(np.sum(y >= k) + 1) / (len(y) + 2) for k in range(1, grades)])
    cut = -np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(len(known)), cut[:1], np.log(np.maximum(np.diff(cut), 1e-2))])
    if len(set(y.tolist())) < 2:
        steps = 0
    m, v, d = np.zeros_like(theta), np.zeros_like(theta), len(known)
    above = y[:, None] >= np.arange(1, grades)
    for t in range(1, steps + 1):
        score = np.bincount(row, theta[:d][col], len(rows)) if d else np.zeros(len(rows))
        gaps = np.exp(theta[d + 1 :])
        b = theta[d] + np.concatenate([[0], np.cumsum(gaps)])
        tail = np.hstack([np.ones((len(rows), 1)), sigmoid(score[:, None] - b), np.zeros((len(rows), 1))])
        p = np.take_along_axis(tail, y[:, None], 1) - np.take_along_axis(tail, y[:, None] + 1, 1)
        slope = tail * (1 - tail)
        i = np.arange(len(rows))
        # d log p / d score, and by threshold: the upper end of the own grade and the lower
        lower, upper = slope[i, y] / np.maximum(p[:, 0], 1e-12), slope[i, y + 1] / np.maximum(p[:, 0], 1e-12)
        by_b = np.array([-lower[y == k].sum() + upper[y == k - 1].sum() for k in range(1, grades)])
        grad = np.concatenate([np.bincount(col, (lower - upper)[row], d) - l2 * theta[:d], [by_b.sum()], np.cumsum(by_b[::-1])[::-1][1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    del above
    return CumulativeLink(known, theta[:d], theta[d] + np.concatenate([[0], np.cumsum(np.exp(theta[d + 1 :]))]))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 where toxic, else 1 for poor and 2 for good; a row with a null label or id is left out."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).filter("doc_id IS NOT NULL AND grade IS NOT NULL")


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> CumulativeLink:
    """Fits on at most ``most`` labelled rows, chosen by hash of the id, so that reruns agree."""
    chosen = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Buckets()
        for b in batches:
            x = pa.array([features(t, memo) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), x], names=["doc_id", "grade", "x"])

    # chosen has at most ``most`` rows of two numbers: a proven bound; of rows that share an id the smallest text counts
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    rows = found.select("doc_id", "grade", "text").mapInArrow(run, "doc_id long, grade int, x array<int>").collect()
    return fit([(r.x, r.grade) for r in sorted(rows, key=lambda r: (r.doc_id, r.grade, len(r.x)))])


def grade(docs: DataFrame, model: CumulativeLink, keep_columns: bool = False) -> DataFrame:
    """doc_id, expected_grade, p_ge_1, p_ge_2, ... and selected for every row (with all of docs' columns if asked).

    Null counts as the empty text, which has shape features only. Whole texts
    are read; repeated rows get the same values; an empty table gives no rows.
    Columns of docs named like a result are replaced.
    """
    tails = [f"p_ge_{k}" for k in range(1, len(model.thresholds) + 1)]
    own = ["expected_grade", *tails, "selected"]
    weights = {int(b): float(w) for b, w in zip(model.buckets, model.weights, strict=True)}
    shared = docs.sparkSession.sparkContext.broadcast((weights, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, model = shared.value
        memo = Buckets()
        for b in batches:
            score = np.array([sum(weights.get(i, 0.0) for i in sorted(features(t, memo))) for t in b.column("__text").to_pylist()], float)
            p = model.tails(score)
            last = b.schema.names.index("__text")
            columns = [b.column(i) for i in range(len(b.schema.names)) if i != last]
            names = [n for n in b.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p.sum(1)), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] >= SELECT)], names=[*names, *own])

    rows = docs.drop(*own) if keep_columns else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("__text", text_of())
    rows = rows if keep_columns else rows.drop("text")
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__text"]
    return rows.mapInArrow(run, ", ".join([*kept, "expected_grade double", *(f"{t} double" for t in tails), "selected boolean"]))


def selected(docs: DataFrame, model: CumulativeLink) -> DataFrame:
    """The rows of docs that ``grade`` selects, with docs' columns as they are, whatever their names."""
    columns = docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(columns))]).withColumn("text", F.col(f"c{columns.index('text')}"))
    return grade(own, model, keep_columns=True).filter("selected").select(*[f"c{i}" for i in range(len(columns))]).toDF(*columns)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return grade(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

"""Hybrid search, journals, snapshots and overviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import cosine_to, has_tag, journal_words, keyword_score
from ..operators.relational import top

#: The score of an exact name, and the weights of vector and words in a journal search.
EXACT, BY_VECTOR, BY_WORDS = 2.0, 0.7, 0.3


def chunk_search(chunks: DataFrame, vector: Sequence[float], exact: F.Column | None = None, n: int = 10, key: str = "path", embedding: str = "vector") -> DataFrame:
    """key and score of the n best: 2.0 where a chunk's name is meant exactly, else the best cosine of its chunks."""
    scored = chunks.select(key, embedding, *[c for c in chunks.columns if c not in (key, embedding)]).withColumn("__cos", cosine_to(F.col(embedding), vector)).withColumn("__exact", F.coalesce(exact, F.lit(False)) if exact is not None else F.lit(False))
    best = scored.groupBy(key).agg(F.when(F.bool_or("__exact"), EXACT).otherwise(F.max("__cos")).alias("score"))
    return top(best, "score", key, n)


def journal_search(entries: DataFrame, text: F.Column, words: Sequence[str], vector: Sequence[float] | None = None, n: int = 5, key: str = "id") -> DataFrame:
    """entries with score: words alone, or 0.7 cosine and 0.3 words where entry and query have a vector; the n best."""
    by_words = keyword_score(text, words)
    score = by_words
    if vector is not None:
        own = F.coalesce(F.col("vector"), F.array().cast("array<float>"))
        cos = F.least(F.greatest(cosine_to(own, vector), F.lit(-1.0)), F.lit(1.0))
        score = F.when(F.size(own) > 0, BY_VECTOR * cos + BY_WORDS * by_words).otherwise(by_words)
    return top(entries.withColumn("score", score), "score", key, n)


def recall(entries: DataFrame, query: str, vector: Sequence[float] | None = None, n: int = 5, tags: Sequence[str] = (), project: str = "") -> DataFrame:
    """The n best entries of a journal for a query, with rank and score: those with one of the tags and the project in their path.

    Words are sought in intent, decision and tags. The query may not be empty.
    A vector of another size than an entry's says nothing about it: words alone count.
    """
    if not query.strip():
        raise ValueError("an empty query")
    kept = entries.filter(has_tag(F.col("tags"), tags) & F.contains("project_path", F.lit(project)))
    if vector is not None:
        kept = kept.withColumn("vector", F.when(F.size("vector") == len(vector), F.col("vector")))
    text = F.concat_ws(" ", "intent", "decision", F.array_join("tags", " "))
    best = journal_search(kept, text, journal_words(query), vector, max(1, n))
    order = Window.orderBy(F.desc("score"), "id")  # n rows at most
    return best.withColumn("rank", F.row_number().over(order))


def compare_snapshots(rows: DataFrame, tag: str, a: str, b: str, keys: list[str], text: str) -> DataFrame:
    """keys and same for each that both tags have: whether the texts are equal without blanks at their ends."""
    left = rows.filter(F.col(tag) == a).select(*keys, F.col(text).alias("x"))
    right = rows.filter(F.col(tag) == b).select(*keys, F.col(text).alias("y"))
    return left.join(right, keys).select(*keys, (F.trim("x") == F.trim("y")).alias("same"))

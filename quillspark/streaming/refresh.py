"""Keeps an index table in step with files that arrive in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, folder: str, schema: str, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands each batch of new Parquet files of a folder to ``each`` once, and stops when none are left."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""The corpus pipeline: quality, exact and near duplicates, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, mixing, near_dedup, packing, quality
from quillspark.llm.common import Scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the labelled documents, selects."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.selected(docs, model)


def numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that tells rows apart whatever their ids, and its name, which no column of docs has; written, so that every reading has the same numbers."""
    row = "_row"
    while row in docs.columns:
        row = f"_{row}"
    return Scratch(spark, "numbered").table(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def kept_rows(rows: DataFrame, row: str, decided: DataFrame) -> DataFrame:
    kept = decided.filter("kept").select(F.col("row").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id, of several such one."""
    rows, row = numbered(spark, docs)
    return kept_rows(rows, row, exact_dedup.exact_duplicates(rows, row_col=row))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the smallest id, of several such one."""
    rows, row = numbered(spark, docs)
    return kept_rows(rows, row, near_dedup.near_rows(rows, row_col=row))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight asks."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences along the curve; row tells copies of a document apart."""
    return packing.pack(docs)


STAGES = [("quality", keep_quality), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("mix", mix), ("pack", pack)]

#: The classifier's fit and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again by the next."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

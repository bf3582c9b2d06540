"""Tables that cut lineage, below the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Writes tables to the folder that the driver and all executors share, and reads them back.

    Where the setting is unset, as in tests on one machine, a temporary folder is
    made and set; on a cluster that is an error.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="spark-tables-", dir="/tmp")
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark, self.path = spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

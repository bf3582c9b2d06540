"""Tables that are replaced at once: each version has its own folder, and a row in a log of commits makes it the newest."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMITS = "version long, folder string, at timestamp"


class Versions:
    """The versions of a table below a folder that the driver and all executors share.

    A version is written whole before its commit; a write that fails leaves the
    newest version as it was. Older versions stay, so that running readers, and
    the job that writes the next version from this one, go on reading theirs,
    until ``forget``. One writer at a time: of two at once the later commit holds.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = spark.createDataFrame([], schema).schema

    def commits(self) -> DataFrame:
        """version (from 1), folder and time of each commit; empty before the first."""
        try:
            return self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], COMMITS)

    def newest(self, version: int | None = None) -> tuple[int, str | None]:
        """The newest version, or this one, and its folder; 0 without one. Raises LookupError for a version that was never committed."""
        rows = self.commits() if version is None else self.commits().filter(F.col("version") == version)
        got = rows.orderBy(F.desc("version"), F.desc("at"), "folder").first()
        if got is None and version is not None:
            raise LookupError(f"no version {version}")
        return (got.version, got.folder) if got else (0, None)

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or this one, in the table's columns; empty before the first, or where the newest lacks one of them."""
        folder = self.newest(version)[1]
        if folder:
            rows = self.spark.read.parquet(f"{self.path}/{folder}")
            if set(self.schema.names) <= set(rows.columns):
                return rows.select(*self.schema.names)
        return self.spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame) -> int:
        """Writes rows, which may be read from this table, as its next version; returns its number."""
        folder = f"v-{uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.parquet(f"{self.path}/{folder}")
        version = self.newest()[0] + 1
        commit = self.spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(folder).alias("folder"), F.current_timestamp().alias("at"))
        commit.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return version

    def forget(self, keep: int = 2) -> list[str]:
        """Deletes the folders of all versions but the ``keep`` newest, and of writes that never were committed; readers of these must be done, and no writer at work."""
        if keep < 1:
            raise ValueError("the newest version stays")
        kept = {r.folder for r in self.commits().orderBy(F.desc("version"), F.desc("at"), "folder").limit(keep).collect()}
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
        gone = [p for p in found if p.getName().startswith("v-") and p.getName() not in kept]
        for p in gone:
            fs.delete(p, True)
        return sorted(p.getName() for p in gone)

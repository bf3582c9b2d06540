"""State between batches: the newest version of each path, which expires when it is not seen for long."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: Fixed value: what was not seen for a day goes.
DAY_MS = 24 * 60 * 60 * 1000
CHANGES = "path string, version string, before string, status string, seen timestamp"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Newest(StatefulProcessor):
    """Holds version and time of one path; a timer at the time plus ``keep_ms`` makes it expire."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "version string, seen long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        was = self.held.get() if self.held.exists() else None
        newest = None
        for part in rows:  # a path's rows come in pieces; only the newest is kept
            for version, gone, seen in zip(part["version"], part["gone"], part["ms"], strict=True):
                one = (int(seen), bool(gone), "" if version is None else version)
                newest = one if newest is None or one > newest else newest
        if newest is None or (was is not None and newest[0] < was[1]):
            return
        seen, gone, version = newest
        before = was[0] if was is not None else None
        if was is not None:
            self.handle.deleteTimer(was[1] + self.keep_ms)
        if gone:
            self.held.clear()
            status = "deleted" if was is not None else None
        else:
            self.held.update((version, seen))
            self.handle.registerTimer(seen + self.keep_ms)
            status = "new" if was is None else "changed" if before != version else None
        if status:
            yield changes(key[0], before if gone else version, before, status, seen)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            version, seen = self.held.get()
            self.held.clear()
            yield changes(key[0], version, version, "expired", seen)

    def close(self) -> None:
        pass


def changes(path: str, version: str | None, before: str | None, status: str, seen: int) -> pd.DataFrame:
    return pd.DataFrame({"path": [path], "version": [version], "before": [before], "status": [status], "seen": [pd.Timestamp(seen, unit="ms")]})


def newest_versions(seen: DataFrame, late: str = "0 seconds", keep_ms: int = DAY_MS) -> DataFrame:
    """path, version, before, status and time of each change in a stream seen(path, version, seen, gone).

    A path's state is its newest version. Status is new, changed, deleted (a row
    with gone) or expired: not seen for ``keep_ms`` by the stream's watermark,
    which trails the latest time by ``late``. Rows of the held version only put
    the end off; rows older than what is held, or than the watermark, change
    nothing. Of rows of one path and time in a batch the one with gone counts,
    else the one with the largest version. Paths are dealt by hash, a path's
    state is one short row however many rows it gets. The session must keep
    state in RocksDB (``use_state``). Rows without a path or time are left out.
    """
    rows = seen.withWatermark("seen", late).filter(F.col("path").isNotNull() & F.col("seen").isNotNull())
    each = rows.select("path", "version", "seen", F.coalesce("gone", F.lit(False)).alias("gone"), F.unix_millis("seen").alias("ms"))
    return each.groupBy("path").transformWithStateInPandas(Newest(keep_ms), CHANGES, "Append", "EventTime")


def use_state(spark) -> None:
    """Sets the state store that timers need, where the session has none of its own set."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name, "").rpartition(".")[2] in ("", "HDFSBackedStateStoreProvider"):
        spark.conf.set(name, STORE)

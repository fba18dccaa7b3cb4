"""Fixture and result feeds as streams, and review expiry at kickoff.

Late rows are compared, not dropped: the newest ``sync_time`` wins whenever it
arrives, so replaying a feed or receiving it out of order ends in the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import ledger
from ..schemas import RESULT_COLUMNS
from ..sources import tables


def read_feed(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


class VersionedTable:
    """A table as immutable version directories with a pointer file in shared storage.

    The pointer carries the batch id, so a batch that is replayed after a
    failure is recognised and skipped.
    """

    def __init__(self, spark: SparkSession, base: str, schema: T.StructType):
        self.spark, self.base, self.schema = spark, base.rstrip("/"), schema

    def _pointer(self) -> list:
        path = f"{self.base}/pointer"
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return []
        return self.spark.read.schema("batch long, path string").json(path).orderBy(F.col("batch").desc()).head(1)

    def current(self) -> DataFrame:
        head = self._pointer()
        if not head:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(head[0]["path"])

    def done(self, batch: int) -> bool:
        head = self._pointer()
        return bool(head) and head[0]["batch"] >= batch

    def commit(self, df: DataFrame, batch: int) -> None:
        target = tables.write_version(tables.conform(df, self.schema, defaults=False), f"{self.base}/data")
        # Appending one small pointer record is the commit; readers take the highest batch.
        self.spark.createDataFrame([(batch, target)], "batch long, path string").coalesce(1).write.mode("append").json(
            f"{self.base}/pointer"
        )


def _apply(stream: DataFrame, table: VersionedTable, merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    def batch(rows: DataFrame, batch_id: int) -> None:
        if table.done(batch_id):
            return
        table.commit(merge(table.current(), rows), batch_id)

    return (
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def upsert_matches_stream(stream: DataFrame, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Fixture feed: newest row per match wins, result columns are left alone."""
    def merge(current: DataFrame, rows: DataFrame) -> DataFrame:
        newest = ledger.latest(rows, ["match_id"], [F.col("sync_time").desc_nulls_last()])
        stale = newest.join(
            current.select("match_id", F.col("sync_time").alias("_have")), "match_id", "left"
        ).filter(F.col("_have").isNull() | (F.col("sync_time") >= F.col("_have"))).drop("_have")
        return ledger.upsert_feed(current, stale.drop(*RESULT_COLUMNS))

    return _apply(stream, table, merge, checkpoint)


def update_results_stream(stream: DataFrame, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Result feed: update-only, newest ``result_synced_at`` wins, unknown matches are ignored."""
    def merge(current: DataFrame, rows: DataFrame) -> DataFrame:
        newest = ledger.latest(rows, ["match_id"], [F.col("result_synced_at").desc_nulls_last()])
        fresh = newest.join(
            current.select("match_id", F.col("result_synced_at").alias("_have")), "match_id", "left"
        ).filter(F.col("_have").isNull() | (F.col("result_synced_at") >= F.col("_have"))).drop("_have")
        return ledger.update_results(current, fresh)

    return _apply(stream, table, merge, checkpoint)


class ReviewExpiry(StatefulProcessor):
    """Keeps one pending review per run and expires it by an event-time timer at kickoff."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "kickoff_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for status, kickoff in zip(frame["status"], frame["kickoff"]):
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                if status != "pending":
                    self.pending.clear()
                    continue
                at = int(kickoff.timestamp() * 1000)
                self.pending.update((at,))
                self.handle.registerTimer(max(at, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"run_id": pd.Series(dtype="int64"), "status": pd.Series(dtype="object")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.pending.exists():
            self.pending.clear()
            yield pd.DataFrame({"run_id": [key[0]], "status": ["expired"]})

    def close(self) -> None:
        pass


def expire_reviews_stream(reviews: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Stream of expiries from review events (run_id, status, kickoff, event_at).

    State is keyed by run, so it spreads evenly and holds one long per open review.
    """
    return (
        reviews.withWatermark("event_at", lateness).groupBy("run_id").transformWithStateInPandas(
            statefulProcessor=ReviewExpiry(), outputStructType="run_id long, status string", outputMode="Append", timeMode="EventTime"
        )
    )

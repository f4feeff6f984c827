"""Rows dropped as later than the watermark, counted in a table."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

SCHEMA = "query_id string, run_id string, query string, batch_id bigint, operator string, late_rows bigint, watermark string, at string"


class LateRows(StreamingQueryListener):
    """Writes one row per micro-batch and stateful operator that dropped rows: a file of its own, added to `path`.

    An operator counts the rows that reach it: packets before a join, a deduplication or a stateful function, groups
    after a sum inside tasks. A micro-batch that runs again after a failure is listed again, under another run.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        mark = (p.eventTime or {}).get("watermark")
        rows = [(str(p.id), str(p.runId), p.name, p.batchId, o.operatorName, o.numRowsDroppedByWatermark, mark, p.timestamp)
                for o in p.stateOperators if o.numRowsDroppedByWatermark > 0]
        if rows:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> bool:
        """Waits until all micro-batches of a query that has ended are in the table."""
        return self.ended.setdefault(str(query.runId), threading.Event()).wait(seconds)


def watch(spark: SparkSession, path: str) -> LateRows:
    """Starts counting for all queries that `spark` starts from now on; `spark.streams.removeListener` ends it."""
    spark.createDataFrame([], SCHEMA).write.mode("append").parquet(path)
    listener = LateRows(spark, path)
    spark.streams.addListener(listener)
    return listener


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The table that `watch` fills."""
    return spark.read.schema(SCHEMA).parquet(path)

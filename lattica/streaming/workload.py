"""The query-log rollup as a stream, and session and tumbling windows over events."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.workload import merge, rollup


def stream_rollup(log: DataFrame, catalog: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Adds each micro-batch of the log to the rollup kept under ``target``.

    A batch writes the merged rollup as a new version named by the batch's
    number; a batch that is run again after a failure writes its version again
    from the one before, so nothing is counted twice.
    """
    spark = log.sparkSession

    def upsert(batch: DataFrame, number: int) -> None:
        fresh = rollup(batch, catalog)
        parts = [fresh] if number == 0 else [spark.read.parquet(f"{target}/batch={number - 1}"), fresh]
        merge(*parts).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return log.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).queryName(f"rollup-{uuid.uuid4().hex[:8]}").trigger(availableNow=True).start()


def windowed(events: DataFrame, time: str, keys: list[str], width: str, late: str, *aggregates: Column) -> DataFrame:
    """Tumbling windows; state older than ``late`` behind the newest event is dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(*aggregates)


def sessions(events: DataFrame, time: str, key: str, gap: str) -> DataFrame:
    """(key, start, end, events) of runs of events with no gap longer than ``gap``."""
    w = F.session_window(time, gap)
    return events.groupBy(w.alias("session"), key).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "events")

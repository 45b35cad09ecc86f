"""Streams of write batches into a store, and live state of a log, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store

OPS_SCHEMA = "pos long, op string, key binary, value binary"


def read_ops(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of JSON files of ``(pos, op, key, value)`` rows; keys and values in base64."""
    return spark.readStream.schema(OPS_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def ingest(ops: DataFrame, store: Store, checkpoint: str, stream: str = "ingest") -> StreamingQuery:
    """Commit every micro-batch of ``ops`` as one batch. A batch that a restart repeats is committed once: the manifest
    record that makes its rows visible also has its number."""

    def commit(rows: DataFrame, batch_id: int) -> None:
        order = Window.partitionBy("key").orderBy(F.desc("pos"))
        last = rows.withColumn("__nth", F.row_number().over(order)).where("__nth = 1")
        gone = (F.col("op") == "del") | F.col("value").isNull() | (F.length("value") == 0)
        if batch_id <= store.streamed.get(stream, -1):
            return
        store.bulk_write(last.select("key", gone.alias("is_delete"), F.when(~gone, F.col("value")).alias("value")), {"streamed": {stream: batch_id}})
        store.streamed[stream] = batch_id

    return ops.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by type and event-time window of a stream of events, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def live_state(versions: DataFrame) -> DataFrame:
    """The newest version of every key of a stream of versions ``(key, ts, is_delete, value)``, as it changes.

    State is one row for each key; write it in update mode. Deleted keys stay, marked, so that readers can drop them."""
    newest = versions.groupBy("key").agg(F.max(F.struct("ts", "is_delete", "value")).alias("last"))
    return newest.select("key", "last.ts", "last.is_delete", "last.value")

"""Batches of writes as rows of a log."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def apply_batches(ops: DataFrame, latest_ts: Any = 0) -> DataFrame:
    """Versions that ``ops(batch_no, pos, op, key, value)`` commit on top of ``latest_ts``.

    A batch is one commit: all its rows carry the same timestamp, and the last write of a key in it stands. Batches
    count from 1 in the order of ``batch_no``, which is dense; ``op`` is put or del, and an empty value deletes."""
    order = Window.partitionBy("batch_no", "key").orderBy(F.desc("pos"))
    rows = ops.withColumn("__nth", F.row_number().over(order)).where("__nth = 1")
    gone = (F.col("op") == "del") | (F.length("value") == 0) | F.col("value").isNull()
    return rows.select("key", (F.lit(latest_ts) + F.col("batch_no")).alias("ts"), gone.alias("is_delete"), F.when(~gone, F.col("value")).alias("value"))


def put(key: Any, value: Any) -> tuple:
    if not key or not value:
        raise ValueError("keys and values must not be empty; use delete")
    return ("put", key, value)


def delete(key: Any) -> tuple:
    if not key:
        raise ValueError("keys must not be empty")
    return ("del", key, None)

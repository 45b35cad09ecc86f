"""Reads as of a timestamp.

The order of the three steps is the meaning of a snapshot: versions after the read timestamp go, then the newest
version of each key is taken, then keys whose newest version is a tombstone go. Key bounds commute with all three and
stand first, so that they reach the scan.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import UNBOUNDED, Bound, in_bounds, in_order, literal, prefix_bounds


def latest_commit(log: DataFrame) -> int:
    """The largest commit timestamp, 0 for an empty log."""
    return log.agg(F.coalesce(F.max("ts"), F.lit(0))).first()[0]


def newest(log: DataFrame, read_ts: Any = None) -> DataFrame:
    """The newest version at or before ``read_ts`` of each key, tombstones included.

    ``row_number() = 1`` makes Spark keep one row for each key in every task before it shuffles."""
    rows = log if read_ts is None else log.where(F.col("ts") <= read_ts)
    order = Window.partitionBy("key").orderBy(F.desc("ts"))
    return rows.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")


def visible(log: DataFrame, read_ts: Any = None) -> DataFrame:
    """Live keys with their version, as of ``read_ts``; all columns stay."""
    return newest(log, read_ts).where(~F.col("is_delete"))


def scan(log: DataFrame, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED, read_ts: Any = None, ordered: bool = True) -> DataFrame:
    """``(key, value)`` of the live keys between two bounds, by key."""
    out = visible(log.where(in_bounds(lower, upper)), read_ts).select("key", "value")
    return out.orderBy("key") if ordered else out


def prefix_scan(log: DataFrame, prefix: Any, read_ts: Any = None, ordered: bool = True) -> DataFrame:
    """A scan of the keys that start with ``prefix``, as a range of keys."""
    return scan(log, *prefix_bounds(prefix), read_ts, ordered)


def get(log: DataFrame, key: Any, read_ts: Any = None) -> DataFrame:
    """``(key, value)`` of one key: one row, or none if it is missing or deleted. Takes the top row, sorts nothing else."""
    rows = log.where(F.col("key") == literal(key))
    rows = rows if read_ts is None else rows.where(F.col("ts") <= read_ts)
    return rows.orderBy(F.desc("ts")).limit(1).where(~F.col("is_delete")).select("key", "value")


def multi_get(log: DataFrame, keys: DataFrame, read_ts: Any = None) -> DataFrame:
    """``(key, status, value)`` for every key of ``keys(key)``: found, deleted or missing."""
    probes = keys.select("key").distinct()
    state = newest(log.join(probes, "key", "left_semi"), read_ts).select("key", "is_delete", "value")
    status = F.when(F.col("is_delete").isNull(), "missing").when(F.col("is_delete"), "deleted").otherwise("found")
    return probes.join(state, "key", "left").select("key", status.alias("status"), F.when(~F.col("is_delete"), F.col("value")).alias("value"))


def all_versions(log: DataFrame, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED, ordered: bool = True) -> DataFrame:
    """Every version between two bounds, tombstones included, by key and newest first."""
    rows = log.where(in_bounds(lower, upper)).select("key", "ts", "is_delete", "value")
    return in_order(rows) if ordered else rows


def hidden(log: DataFrame, read_ts: Any = None) -> DataFrame:
    """``(key, ts)`` of the tombstones that hide their key as of ``read_ts``."""
    return newest(log, read_ts).where("is_delete").select("key", "ts")


def asof_lookup(log: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes(probe_id, key, read_ts)`` with the value each would read, null if missing or deleted.

    Probes and versions of a key are merged in timestamp order and the last version seen is carried on to the probes:
    one shuffle on the key and no join of all versions with all probes."""
    versions = log.select("key", F.col("ts").alias("__at"), F.lit(0).alias("__kind"), F.struct("is_delete", "value").alias("__v"), F.lit(None).cast(probes.schema["probe_id"].dataType).alias("probe_id"))
    asks = probes.select("key", F.col("read_ts").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(versions.schema["__v"].dataType).alias("__v"), "probe_id")
    order = Window.partitionBy("key").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = versions.unionByName(asks).withColumn("__last", F.last("__v", ignorenulls=True).over(order)).where("__kind = 1")
    return seen.select("probe_id", "key", F.col("__at").alias("read_ts"), F.when(~F.col("__last.is_delete"), F.col("__last.value")).alias("value"))

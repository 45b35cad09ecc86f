"""Metadata of runs, and the choice of runs that a read must open.

``runs`` rows are ``(run_id, level, prio, first_key, last_key, max_ts, entries, bytes)``: one for each run, so this
table is small whatever the data's size.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import entry_size
from ..model import UNBOUNDED, Bound, literal


def run_stats(log: DataFrame) -> DataFrame:
    """Key range, newest timestamp, entries and bytes of every ``run_id``, in one pass with partial sums."""
    return log.groupBy("run_id").agg(
        F.min("key").alias("first_key"),
        F.max("key").alias("last_key"),
        F.max("ts").alias("max_ts"),
        F.count(F.lit(1)).alias("entries"),
        F.sum(entry_size("key", "value")).alias("bytes"),
    )


def overlaps(lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED) -> Column:
    """True for runs whose key range meets the range between the bounds."""
    out = F.lit(True)
    if lower.kind == "included":
        out = out & (F.col("last_key") >= literal(lower.key))
    elif lower.kind == "excluded":
        out = out & (F.col("last_key") > literal(lower.key))
    if upper.kind == "included":
        out = out & (F.col("first_key") <= literal(upper.key))
    elif upper.kind == "excluded":
        out = out & (F.col("first_key") < literal(upper.key))
    return out


def holds(key: Any) -> Column:
    """True for runs whose key range has the key."""
    return (F.col("first_key") <= literal(key)) & (F.col("last_key") >= literal(key))


def overlapping_pairs(runs: DataFrame) -> DataFrame:
    """``(run_id, other_id)`` of runs whose key ranges meet, each pair once."""
    a = runs.select("run_id", "first_key", "last_key")
    b = runs.select(F.col("run_id").alias("other_id"), F.col("first_key").alias("other_first"), F.col("last_key").alias("other_last"))
    return a.join(b, (F.col("run_id") < F.col("other_id")) & (F.col("first_key") <= F.col("other_last")) & (F.col("other_first") <= F.col("last_key"))).select("run_id", "other_id")


def level_summary(runs: DataFrame) -> DataFrame:
    """``(level, files, bytes, entries)``."""
    return runs.groupBy("level").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sum("entries").alias("entries"))

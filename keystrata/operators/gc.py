"""Garbage collection of versions that no reader can see.

With the low-watermark W, the oldest timestamp that a reader may still read at, a version is kept if it is newer than
W, or if it is the newest of its key at or below W, unless a filter drops the key, or the merge reaches the bottom
level and the version is a tombstone with no newer version.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import in_bounds, prefix_bounds


def prefix_filter(*prefixes: Any) -> Column:
    """True for keys that start with one of the prefixes."""
    out = F.lit(False)
    for p in prefixes:
        out = out | in_bounds(*prefix_bounds(p))
    return out


def collect(versions: DataFrame, watermark: Any, bottom: bool = False, dropped: Column | None = None) -> DataFrame:
    """The versions to keep of ``versions(key, ts, is_delete, ...)``, where each ``(key, ts)`` stands once.

    What is newer than the watermark stays as it is, without a shuffle. Of the rest one version a key can stay: each
    task takes the newest of its own before they meet, so a key of very many versions is no more work for one task
    than any other."""
    columns = versions.columns
    below = F.when(F.col("ts") <= watermark, F.col("ts"))
    newest = versions.groupBy(F.col("key").alias("__key")).agg(F.max_by(F.struct(*columns), below).alias("__row"), F.max("ts").alias("__newest"))
    rest = newest.where(F.col("__row").isNotNull()).select("__row.*", "__newest")
    if dropped is not None:
        rest = rest.where(~dropped)
    if bottom:
        rest = rest.where(~(F.col("is_delete") & (F.col("ts") == F.col("__newest"))))
    return versions.where(F.col("ts") > watermark).unionByName(rest.select(*columns))

"""Snapshot reads with a local overlay, optimistic checks, and the registry of readers, as relations."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import UNBOUNDED, Bound, in_bounds
from .snapshot import visible


def overlay_scan(log: DataFrame, overlay: DataFrame, read_ts: Any, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED, ordered: bool = True) -> DataFrame:
    """What a transaction scans: its own writes ``overlay(key, is_delete, value)``, one for each key, over its snapshot."""
    own = overlay.where(in_bounds(lower, upper))
    rest = visible(log.where(in_bounds(lower, upper)), read_ts).join(own.select("key"), "key", "left_anti")
    out = own.where(~F.col("is_delete")).select("key", "value").unionByName(rest.select("key", "value"))
    return out.orderBy("key") if ordered else out


def conflicts(reads: DataFrame, commits: DataFrame) -> DataFrame:
    """``(txn, key)`` of reads that a later commit has overwritten.

    ``reads(txn, key, read_ts)`` are the keys that transactions read, ``commits(commit_ts, key)`` the keys that others
    wrote. A read conflicts if its key was written after the transaction's snapshot; the newest commit of a key decides,
    so one row for each key meets the reads."""
    last = commits.groupBy("key").agg(F.max("commit_ts").alias("commit_ts"))
    return reads.join(last, "key").where(F.col("commit_ts") > F.col("read_ts")).select("txn", "key").distinct()


def decide(txns: DataFrame, reads: DataFrame, writes: DataFrame, commits: DataFrame) -> DataFrame:
    """``(txn, outcome)``: committed or aborted; a transaction that writes nothing always commits.

    ``txns(txn, read_ts)``, ``reads(txn, key)`` and ``writes(txn, key)``; writes that meet other writes do not conflict."""
    writers = writes.select("txn").distinct()
    asked = reads.join(writers, "txn", "left_semi").join(txns, "txn").select("txn", "key", "read_ts")
    bad = conflicts(asked, commits).select("txn").distinct().withColumn("__bad", F.lit(True))
    return txns.join(bad, "txn", "left").select("txn", F.when(F.col("__bad"), "aborted").otherwise("committed").alias("outcome"))


def prune_commits(commits: DataFrame, watermark: Any) -> DataFrame:
    """The commits that some reader may still conflict with."""
    return commits.where(F.col("commit_ts") >= watermark)


def live_readers(changes: DataFrame) -> DataFrame:
    """``(read_ts, readers)`` after ``changes(read_ts, delta)``, where delta is +1 for a reader that begins and -1 for one that ends."""
    return changes.groupBy("read_ts").agg(F.sum("delta").alias("readers")).where("readers > 0")


def low_watermark(changes: DataFrame, latest_commit: Any) -> DataFrame:
    """``(low_watermark, retained)``: the oldest timestamp still read, else the latest commit; and how many are read."""
    return live_readers(changes).agg(F.coalesce(F.min("read_ts"), F.lit(latest_commit)).alias("low_watermark"), F.count(F.lit(1)).alias("retained"))

"""The data model: one relation of versions, ``(key, ts, is_delete, value)``, and bounds on keys.

A row is a version of a key: ``ts`` is its commit timestamp, ``is_delete`` marks a tombstone. ``(key, ts)`` names a
version; where several sources hold the same version, the newest source's row stands. Keys order as bytes ascending,
versions of a key by ``ts`` descending. Keys and values are binary or strings; both compare bytewise.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("ts", T.LongType(), False),
        T.StructField("is_delete", T.BooleanType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)



@dataclass(frozen=True)
class Bound:
    """One end of a key range: unbounded, or a key that is included or excluded."""

    kind: str
    key: Any = None

    def __post_init__(self) -> None:
        if self.kind not in ("unbounded", "included", "excluded"):
            raise ValueError(f"unknown kind of bound: {self.kind}")
        if (self.kind == "unbounded") != (self.key is None):
            raise ValueError("a bound has a key unless it is unbounded")

    @staticmethod
    def unbounded() -> Bound:
        return Bound("unbounded")

    @staticmethod
    def incl(key: Any) -> Bound:
        return Bound("included", key)

    @staticmethod
    def excl(key: Any) -> Bound:
        return Bound("excluded", key)


UNBOUNDED = Bound.unbounded()


def literal(key: Any) -> Column:
    return F.lit(bytearray(key)) if isinstance(key, bytes) else F.lit(key)


def in_bounds(lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED, key: str = "key") -> Column:
    """The range as comparisons of the key with literals, which reach the Parquet scan."""
    out = F.lit(True)
    if lower.kind == "included":
        out = F.col(key) >= literal(lower.key)
    elif lower.kind == "excluded":
        out = F.col(key) > literal(lower.key)
    if upper.kind == "included":
        out = out & (F.col(key) <= literal(upper.key))
    elif upper.kind == "excluded":
        out = out & (F.col(key) < literal(upper.key))
    return out


def prefix_bounds(prefix: Any) -> tuple[Bound, Bound]:
    """The range of all keys that start with ``prefix``; for strings the last character must not be the greatest."""
    if not prefix:
        return UNBOUNDED, UNBOUNDED
    if isinstance(prefix, bytes):
        head = prefix.rstrip(b"\xff")
        return Bound.incl(prefix), Bound.excl(head[:-1] + bytes([head[-1] + 1])) if head else UNBOUNDED
    head = prefix.rstrip(chr(0x10FFFF))
    if not head:
        return Bound.incl(prefix), UNBOUNDED
    after = ord(head[-1]) + 1
    return Bound.incl(prefix), Bound.excl(head[:-1] + chr(0xE000 if after == 0xD800 else after))


def in_order(df: DataFrame) -> DataFrame:
    """Rows by key, newest version first."""
    return df.orderBy(F.asc("key"), F.desc("ts"))


def user_key(n: Column) -> Column:
    """``u`` and the number, padded to five digits and never cut."""
    digits = n.cast("string")
    return F.concat(F.lit("u"), F.lpad(digits, F.greatest(F.lit(5), F.length(digits)), F.lit("0")))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a log of versions.

    Keys are users, commit timestamps count the events, an ``error`` event deletes its key; runs hold 1,000 commits."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    error = F.col("event_type") == "error"
    return events.select(
        user_key(F.col("user_id")).alias("key"),
        (F.col("event_id") + 1).alias("ts"),
        error.alias("is_delete"),
        F.when(error, "").otherwise(F.concat("event_type", F.lit("@"), F.col("event_id").cast("string"))).alias("value"),
        F.expr("CAST(event_id DIV 1000 AS INT)").alias("run_id"),
    )


#: The same relation in DuckDB, for the oracle queries.
EVENT_LOG_SQL = """
  SELECT concat('u', lpad(CAST(user_id AS VARCHAR), 5, '0')) AS key, event_id + 1 AS ts, event_type = 'error' AS is_delete,
         CASE WHEN event_type = 'error' THEN '' ELSE concat(event_type, '@', CAST(event_id AS VARCHAR)) END AS value,
         CAST(event_id // 1000 AS INTEGER) AS run_id
  FROM events"""

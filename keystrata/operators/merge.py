"""Merges of runs: a sorted union in which, for equal ``(key, ts)``, the earlier source's row stands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import in_order

COLUMNS = ("key", "ts", "is_delete", "value")


def with_priority(*sources: DataFrame) -> DataFrame:
    """All rows of the sources with ``prio``, the place of their source."""
    return reduce(DataFrame.unionByName, [s.select(*COLUMNS, F.lit(i).alias("prio")) for i, s in enumerate(sources)])


def resolve(rows: DataFrame) -> DataFrame:
    """One row for each ``(key, ts)`` of ``rows(..., prio)``: that of least ``prio``. Tombstones stay."""
    order = Window.partitionBy("key", "ts").orderBy("prio")
    return rows.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")


def merge_k(*sources: DataFrame, ordered: bool = True) -> DataFrame:
    """Merge of any number of sources, newest first."""
    out = resolve(with_priority(*sources)).select(*COLUMNS)
    return in_order(out) if ordered else out


def merge_two(a: DataFrame, b: DataFrame, on: tuple[str, ...] = ("key", "ts"), ordered: bool = True) -> DataFrame:
    """Merge of two sources that hold each ``on`` once: all of ``a``, and the rows of ``b`` that ``a`` lacks."""
    out = a.select(*COLUMNS).unionByName(b.join(a.select(*on).distinct(), list(on), "left_anti").select(*COLUMNS))
    return in_order(out) if ordered else out


def concat(*runs: DataFrame, ordered: bool = True) -> DataFrame:
    """Union of runs whose key ranges do not meet; nothing to resolve."""
    out = reduce(DataFrame.unionByName, [r.select(*COLUMNS) for r in runs])
    return in_order(out) if ordered else out


def concat_violations(runs: DataFrame) -> DataFrame:
    """Neighbours of ``runs(run_id, first_key, last_key)`` that are out of order or meet; none if they can be concatenated.

    Run metadata is small: it is ordered in one task."""
    order = Window.orderBy("first_key", "run_id")
    rows = runs.withColumns({"next_id": F.lead("run_id").over(order), "next_first": F.lead("first_key").over(order)})
    return rows.where((F.col("first_key") > F.col("last_key")) | (F.col("next_first") <= F.col("last_key"))).select("run_id", "last_key", "next_id", "next_first")

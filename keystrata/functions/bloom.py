"""Bloom filters over 32-bit key hashes as relations: a filter is its set bits, one row each."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import U32


def bits_per_key(false_positive_rate: float) -> int:
    return math.ceil(-math.log(false_positive_rate) / math.log(2) ** 2)


@dataclass(frozen=True)
class Shape:
    """Bits and probes of a filter for so many keys."""

    bits: int
    probes: int

    @staticmethod
    def of(keys: int, per_key: int) -> Shape:
        bits = -(-max(keys * per_key, 64) // 8) * 8
        return Shape(bits, min(max(int(per_key * 0.69), 1), 30))


def probe_positions(hash32: Column, shape: Shape) -> Column:
    """The bits of a hash: it steps by itself rotated left by 15 bits, modulo 2**32."""
    h = hash32.cast("long")
    step = F.shiftright(h, 17).bitwiseOR(F.pmod(F.shiftleft(h, 15), F.lit(U32)))
    return F.transform(F.sequence(F.lit(0), F.lit(shape.probes - 1)), lambda i: F.pmod(F.pmod(h + i * step, F.lit(U32)), F.lit(shape.bits)))


def build(keys: DataFrame, shape: Shape, column: str = "hash32") -> DataFrame:
    """``(bit)``: the set bits, at most ``shape.bits`` rows whatever the number of keys."""
    return keys.select(F.explode(probe_positions(F.col(column), shape)).alias("bit")).distinct()


def may_contain(probes: DataFrame, bits: DataFrame, shape: Shape, column: str = "hash32") -> DataFrame:
    """``probes`` with ``maybe``: false only for hashes that were not built in."""
    names = probes.select(column).distinct().withColumn("bit", F.explode(F.array_distinct(probe_positions(F.col(column), shape))))
    hit = names.join(bits.withColumn("__set", F.lit(1)), "bit", "left").groupBy(column).agg((F.count("__set") == F.count(F.lit(1))).alias("maybe"))
    return probes.join(hit, column, "left")

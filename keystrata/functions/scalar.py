"""Scalar expressions on keys, sizes and 32-bit numbers; all of them run inside Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 1 << 32
#: Bytes of a commit timestamp beside its key.
TS_BYTES = 8


def raw_key_size(key: Column | str) -> Column:
    """Bytes of a key with its timestamp."""
    return (F.octet_length(key) + TS_BYTES).cast("long")


def entry_size(key: Column | str, value: Column | str) -> Column:
    """Bytes that a version adds to a write buffer; a tombstone's value has none."""
    return raw_key_size(key) + F.coalesce(F.octet_length(value), F.lit(0)).cast("long")


def common_prefix_length(a: Column, b: Column) -> Column:
    """Characters (of strings) or bytes (of binaries) that two values share at their start."""
    least = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), least), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(least < 1, F.lit(0)).otherwise(F.coalesce(F.get(differ, F.lit(0)) - 1, least)).cast("long")


def next_power_of_two(n: Column) -> Column:
    """The least power of two that is not below ``n``; 1 for numbers below 2. Exact up to 2**62."""
    below = (n - 1).cast("long")
    for shift in (1, 2, 4, 8, 16, 32):
        below = below.bitwiseOR(F.shiftrightunsigned(below, shift))
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(below + 1)


def wrapping_add_u32(a: Column, b: Column) -> Column:
    return F.pmod(a.cast("long") + b.cast("long"), F.lit(U32))


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def partition_point(values: Column, holds) -> Column:
    """How many leading elements of a partitioned array satisfy ``holds``."""
    return F.size(F.filter(values, holds))


def crc32c(data: bytes) -> int:
    """CRC with the Castagnoli polynomial, bit by bit through a table built from the polynomial."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc = _CRC_TABLE[(crc ^ byte) & 0xFF] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


def _crc_table(polynomial: int = 0x82F63B78) -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (polynomial if n & 1 else 0)
        table.append(n)
    return table


_CRC_TABLE = _crc_table()

"""Folds that reset at a threshold: write-buffer freezes, block packing, and splitting of sorted output.

Whether a row starts a new buffer depends on where the last one started, so a run is folded in order by one task.
Runs are bounded by the store that writes them; different runs are folded side by side.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame

from ..shipping import ship

#: Bytes of a 16-bit length or offset, of a timestamp, and of a block's checksum.
U16, TS, CHECKSUM = 2, 8, 4


def _length(value) -> int:
    return 0 if value is None or value is pd.NA else len(value if isinstance(value, (bytes, bytearray)) else value.encode())


def _raw(key) -> bytes:
    return bytes(key) if isinstance(key, (bytes, bytearray)) else key.encode()


def _freeze(frame: pd.DataFrame, limit: int) -> pd.DataFrame:
    rows, size, number = [], 0, 0
    frame = frame.sort_values("ts")
    for run, ts, key, value in zip(frame["run_id"], frame["ts"], frame["key"], frame["value"]):
        size += len(_raw(key)) + TS + _length(value)
        if size >= limit:
            rows.append((run, number, ts, size))
            size, number = 0, number + 1
    return pd.DataFrame(rows, columns=["run_id", "buffer_no", "ts", "bytes"])


def freeze_points(log: DataFrame, limit: int) -> DataFrame:
    """``(run_id, buffer_no, ts, bytes)``: the writes after which a run's write buffer has reached ``limit`` bytes."""
    ship(log.sparkSession)
    rows = log.select("run_id", "ts", "key", "value")
    return rows.groupBy("run_id").applyInPandas(_grouped(_freeze, limit=limit), "run_id int, buffer_no long, ts long, bytes long")


class _Block:
    """Sizes of a prefix-compressed block while it is filled."""

    def __init__(self):
        self.first, self.data, self.entries = b"", 0, 0

    def size(self) -> int:
        return U16 + self.data + U16 * self.entries

    def fits(self, key: bytes, value: int, limit: int) -> bool:
        return not self.entries or self.size() + len(key) + TS + value + 3 * U16 <= limit

    def add(self, key: bytes, value: int) -> None:
        shared = 0
        for a, b in zip(self.first, key):
            if a != b:
                break
            shared += 1
        self.first = self.first or key
        self.data += 3 * U16 + TS + len(key) - shared + value
        self.entries += 1


def _pack(frame: pd.DataFrame, block: int, table: int | None) -> pd.DataFrame:
    """Block and table of every entry in order; without ``table`` all blocks are of one table."""
    rows, now, done, number, tables, last = [], _Block(), 0, 0, 0, None
    frame = frame.sort_values(["key", "ts"], ascending=[True, False])
    for run, ts, key, value in zip(frame["run_id"], frame["ts"], frame["key"], frame["value"]):
        raw, size = _raw(key), _length(value)
        if table is not None and done >= table and raw != last:
            tables, number, done, now = tables + 1, 0, 0, _Block()
        elif not now.fits(raw, size, block):
            done += now.size() + CHECKSUM
            number, now = number + 1, _Block()
        now.add(raw, size)
        last = raw
        rows.append((run, tables, number, key, ts))
    return pd.DataFrame(rows, columns=["run_id", "table_no", "block_no", "key", "ts"])


def pack_blocks(log: DataFrame, block: int) -> DataFrame:
    """``(run_id, block_no, key, ts)``: blocks of at most ``block`` bytes, each with one entry at least."""
    return split_tables(log, block, None).drop("table_no")


def split_tables(log: DataFrame, block: int, table: int | None) -> DataFrame:
    """``(run_id, table_no, block_no, key, ts)``: a new table starts at a new key once ``table`` bytes of blocks are done."""
    ship(log.sparkSession)
    rows = log.select("run_id", "ts", "key", "value")
    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("run_id").applyInPandas(_grouped(_pack, block=block, table=table), f"run_id int, table_no long, block_no long, key {kind}, ts long")


def _grouped(fold, **given):
    @functools.wraps(fold)
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return fold(frame, **given)

    run.__annotations__ = {}
    del run.__wrapped__
    return run

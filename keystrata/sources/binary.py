"""Readers and writers of the binary layouts: prefix-compressed blocks, sorted tables, commit logs and manifests.

All numbers are big-endian, all checksums CRC-32C.

- Entry: shared prefix length u16, rest length u16, rest of the key, timestamp u64, value length u16, value. The prefix
  is shared with the block's first key.
- Block: entries, an offset u16 for each, their number u16.
- Table: every block with its checksum u32; block metadata; its offset u32; the filter; its offset u32.
- Block metadata: number of blocks u32; for each its offset u32, first key (length u16, bytes, timestamp u64), last key
  alike; newest timestamp u64; checksum u32 of all but the number.
- Filter: bits, number of probes u8, checksum u32.
- Commit log record: key length u16, key, timestamp u64, value length u16, value, checksum u32.
- Manifest record: length u32, type u8, JSON, checksum u32 of the JSON.

``register`` makes the data source formats ``kvtable``, ``kvlog`` and ``kvmanifest`` known to a session; a file is one
partition. Their paths are folders or files that the executors share.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.bloom import Shape
from ..functions.scalar import U32, crc32c
from ..shipping import ship

Version = tuple[bytes, int, bytes]  # an empty value deletes
KINDS = ("compaction", "flush", "new_memtable")


class Corrupt(ValueError):
    """A checksum or a length does not fit the bytes."""


def _checked(data: bytes, crc: int, what: str) -> bytes:
    if crc32c(data) != crc:
        raise Corrupt(f"checksum of {what}")
    return data


def _shared(a: bytes, b: bytes) -> int:
    return len(os.path.commonprefix([a, b]))


def _key(key: bytes, ts: int) -> bytes:
    return struct.pack(">H", len(key)) + key + struct.pack(">Q", ts)


def encode_block(entries: list[Version]) -> bytes:
    data, offsets = bytearray(), []
    for key, ts, value in entries:
        if max(len(key), len(value), len(data)) > 0xFFFF:
            raise ValueError("keys, values and offsets are 16-bit")
        offsets.append(len(data))
        n = _shared(entries[0][0], key) if len(offsets) > 1 else 0
        data += struct.pack(">HH", n, len(key) - n) + key[n:] + struct.pack(">QH", ts, len(value)) + value
    return bytes(data) + b"".join(struct.pack(">H", o) for o in offsets) + struct.pack(">H", len(offsets))


def decode_block(block: bytes) -> Iterator[Version]:
    (count,) = struct.unpack_from(">H", block, len(block) - 2)
    table = len(block) - 2 - 2 * count
    if table < 0:
        raise Corrupt("entries of a block")
    first = b""
    for i in range(count):
        (at,) = struct.unpack_from(">H", block, table + 2 * i)
        n, rest = struct.unpack_from(">HH", block, at)
        key = first[:n] + block[at + 4 : at + 4 + rest]
        ts, size = struct.unpack_from(">QH", block, at + 4 + rest)
        start = at + 4 + rest + 10
        first = first or key
        yield key, ts, block[start : start + size]


def bloom_bits(hashes: list[int], per_key: int = 10) -> tuple[bytes, int]:
    shape = Shape.of(len(hashes), per_key)
    bits = bytearray(shape.bits // 8)
    for h in hashes:
        step = (h >> 17 | h << 15) % U32
        for i in range(shape.probes):
            bit = (h + i * step) % U32 % shape.bits
            bits[bit // 8] |= 1 << bit % 8
    return bytes(bits), shape.probes


def encode_table(versions: list[Version], block_bytes: int = 4096, hashes: list[int] | None = None) -> bytes:
    """A table of versions in order: by key, newest first."""
    from ..functions.folds import _Block

    blocks: list[list[Version]] = []
    now = _Block()
    for v in versions:
        if not blocks or not now.fits(v[0], len(v[2]), block_bytes):
            blocks.append([])
            now = _Block()
        blocks[-1].append(v)
        now.add(v[0], len(v[2]))
    out, meta = bytearray(), bytearray()
    for entries in blocks:
        meta += struct.pack(">I", len(out)) + _key(*entries[0][:2]) + _key(*entries[-1][:2])
        block = encode_block(entries)
        out += block + struct.pack(">I", crc32c(block))
    meta += struct.pack(">Q", max((v[1] for v in versions), default=0))
    at = len(out)
    out += struct.pack(">I", len(blocks)) + meta + struct.pack(">II", crc32c(bytes(meta)), at)
    bits, probes = bloom_bits(hashes or [])
    body = bits + bytes([probes])
    at = len(out)
    return bytes(out) + body + struct.pack(">II", crc32c(body), at)


def table_may_contain(table: bytes, h: int) -> bool:
    """False if the filter rules out that a key with this 32-bit hash is in the table."""
    (at,) = struct.unpack_from(">I", table, len(table) - 4)
    bits, probes = table[at : len(table) - 9], table[len(table) - 9]
    step = (h >> 17 | h << 15) % U32
    places = ((h + i * step) % U32 % (8 * len(bits)) for i in range(probes))
    return probes > 30 or all(bits[p // 8] >> p % 8 & 1 for p in places)


def table_blocks(table: bytes) -> tuple[list[tuple[int, int, bytes, bytes]], int]:
    """(start, end, first key, last key) of every block, and the newest timestamp."""
    (filter_at,) = struct.unpack_from(">I", table, len(table) - 4)
    body = table[filter_at : len(table) - 8]
    _checked(body, struct.unpack_from(">I", table, len(table) - 8)[0], "a filter")
    (meta_at,) = struct.unpack_from(">I", table, filter_at - 4)
    meta = table[meta_at : filter_at - 4]
    (count,) = struct.unpack_from(">I", meta)
    _checked(meta[4:-4], struct.unpack_from(">I", meta, len(meta) - 4)[0], "block metadata")
    rows, at = [], 4
    for _ in range(count):
        (start,) = struct.unpack_from(">I", meta, at)
        at += 4
        keys = []
        for _ in range(2):
            (n,) = struct.unpack_from(">H", meta, at)
            keys.append(meta[at + 2 : at + 2 + n])
            at += 2 + n + 8
        rows.append((start, *keys))
    ends = [r[0] for r in rows[1:]] + [meta_at]
    return [(start, end - 4, a, b) for (start, a, b), end in zip(rows, ends)], struct.unpack_from(">Q", meta, at)[0]


def decode_table(table: bytes, lower: bytes | None = None, upper: bytes | None = None) -> Iterator[Version]:
    """The versions of a table; blocks outside the keys ``lower`` to ``upper`` are not decoded."""
    for start, end, first, last in table_blocks(table)[0]:
        if lower is not None and last < lower or upper is not None and first > upper:
            continue
        (crc,) = struct.unpack_from(">I", table, end)
        yield from decode_block(_checked(table[start:end], crc, "a block"))


def encode_log(versions: list[Version]) -> bytes:
    out = bytearray()
    for key, ts, value in versions:
        body = _key(key, ts) + struct.pack(">H", len(value)) + value
        out += body + struct.pack(">I", crc32c(body))
    return bytes(out)


def decode_log(data: bytes, strict: bool = False) -> Iterator[Version]:
    """The records of a commit log, up to a torn end unless ``strict``."""
    at = 0
    while at < len(data):
        try:
            (n,) = struct.unpack_from(">H", data, at)
            ts, size = struct.unpack_from(">QH", data, at + 2 + n)
            end = at + 2 + n + 10 + size
            (crc,) = struct.unpack_from(">I", data, end)
        except struct.error:
            if strict:
                raise Corrupt("end of a log") from None
            return
        body = _checked(data[at:end], crc, "a log record")
        yield body[2 : 2 + n], ts, body[2 + n + 10 :]
        at = end + 4


def encode_manifest(records: list[tuple[int, dict]]) -> bytes:
    out = bytearray()
    for kind, content in records:
        body = json.dumps(content).encode()
        out += struct.pack(">IB", len(body), kind) + body + struct.pack(">I", crc32c(body))
    return bytes(out)


def decode_manifest(data: bytes) -> Iterator[tuple[int, dict]]:
    at = 0
    while at + 5 <= len(data):
        size, kind = struct.unpack_from(">IB", data, at)
        body = data[at + 5 : at + 5 + size]
        (crc,) = struct.unpack_from(">I", data, at + 5 + size)
        yield kind, json.loads(_checked(body, crc, "a manifest record"))
        at += 9 + size


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, suffix: str):
        self.path, self.suffix = options["path"].removeprefix("file://").removeprefix("file:"), suffix

    def partitions(self) -> list[_File]:
        if os.path.isdir(self.path):
            return [_File(os.path.join(self.path, n)) for n in sorted(os.listdir(self.path)) if n.endswith(self.suffix)]
        return [_File(self.path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            yield from self.rows(f.read())

    def rows(self, data: bytes) -> Iterator[tuple]:
        raise NotImplementedError


class _TableReader(_Reader):
    def rows(self, data: bytes) -> Iterator[tuple]:
        for key, ts, value in decode_table(data):
            yield key, ts, not value, value or None


class _LogReader(_Reader):
    def rows(self, data: bytes) -> Iterator[tuple]:
        for key, ts, value in decode_log(data):
            yield key, ts, not value, value or None


class _ManifestReader(_Reader):
    def rows(self, data: bytes) -> Iterator[tuple]:
        for i, (kind, content) in enumerate(decode_manifest(data)):
            yield i, kind, json.dumps(content)


class KvTable(DataSource):
    """Versions of sorted tables."""

    @classmethod
    def name(cls) -> str:
        return "kvtable"

    def schema(self) -> str:
        return "key binary, ts long, is_delete boolean, value binary"

    def reader(self, schema) -> DataSourceReader:
        return _TableReader(self.options, ".sst")


class KvLog(KvTable):
    """Versions of commit logs."""

    @classmethod
    def name(cls) -> str:
        return "kvlog"

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(self.options, ".wal")


class KvManifest(DataSource):
    """Records of a manifest, in order."""

    @classmethod
    def name(cls) -> str:
        return "kvmanifest"

    def schema(self) -> str:
        return "seq long, type int, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _ManifestReader(self.options, "")


def register(spark: SparkSession) -> None:
    ship(spark)
    for source in (KvTable, KvLog, KvManifest):
        spark.dataSource.register(source)

"""Bounded-space online packing of tokenised documents into fixed-length training sequences.

Each partition reads its documents once and keeps at most ``open_windows`` partly filled windows. A document longer
than a window is cut into full windows and a rest; a piece goes to the open window that it fills best; when none has
room, the fullest window is emitted and a new one opened. What is still open at the end of a partition is merged by
the same rule in rounds of ``fan_in`` partitions, so no task ever holds more than ``fan_in * open_windows`` windows.

Cases: a null text counts as empty and gives one piece that holds only the end id; ties between equally full windows
go to the older one; repeated documents are packed each on their own; an empty table gives no rows; columns other
than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY = 4096
OPEN_WINDOWS = 64
FAN_IN = 32
END_ID = 2
#: A window's number is its partition, shifted by so many bits, plus its number there.
PARTITION_SHIFT = 36
#: Word pieces that a Python worker remembers; the memory is emptied when full, which changes no result.
REMEMBERED = 250_000
#: ASCII marks that may follow a word; the apostrophe, which begins contractions, is not among them.
MARKS = b".,;:!?*$%&#|()[]{}\"-"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, filled long, open boolean"


class _Words(dict):
    """Token ids of a word as little-endian bytes, computed once per worker for each short word.

    The vocabulary's normaliser drops white space and its pieces never cross white space, so the ids of a text are
    those of its words, one after the other. Its pieces are runs of letters, or of marks, or single digits: marks
    after a letter or digit can be split off. A word of small ASCII letters is one piece that no step before the
    merges changes, so it goes to the library's merges at once; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        self.path = path

    @functools.cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @functools.cached_property
    def merge(self):
        return self.tokenizer.model.tokenize

    def forget(self) -> None:
        """Empty the memory and drop the tokenizer until a word is asked for."""
        self.clear()
        for name in ("tokenizer", "merge"):
            self.__dict__.pop(name, None)

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(MARKS)
        if len(core) < len(word) and core[-1:].isalnum():
            ids = self[core] + self[word[len(core) :]]
        elif word.islower() and word.isalpha():
            ids = array("I", [t.id for t in self.merge(word.decode())]).tobytes()
        else:
            ids = array("I", self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    def split(self, text: bytes) -> list[bytes]:
        """Words, with A-Z in lower case as the normaliser leaves them; names of special tokens keep their case."""
        return (text if b"<|" in text else text.lower()).split()


@functools.lru_cache(maxsize=2)
def _word_ids(path: str) -> _Words:
    return _Words(path)


class Packer:
    """The open windows of one stream of pieces. ``place`` returns the window of a piece and the windows it closed."""

    def __init__(self, capacity: int, open_windows: int):
        self.capacity, self.most = capacity, open_windows
        self.rooms: list[tuple[int, int]] = []  # (room left, window), the fullest first
        self.filled: dict[int, int] = {}
        self.next = 0

    def place(self, length: int) -> tuple[int, int, int | None]:
        """Window, offset there, and the window that had to be emitted to make room."""
        emitted = None
        at = bisect_left(self.rooms, (length, -1))
        if at == len(self.rooms):
            if len(self.rooms) >= self.most:
                emitted = self.rooms.pop(0)[1]
            window, room = self.next, self.capacity
            self.next += 1
            self.filled[window] = 0
        else:
            room, window = self.rooms.pop(at)
        offset = self.filled[window]
        self.filled[window] += length
        if room > length:
            insort(self.rooms, (room - length, window))
        return window, offset, emitted

    def open(self) -> set[int]:
        return {w for _, w in self.rooms}


@common.tidy
def _pack_partition(batches: Iterator[pd.DataFrame], path: str, capacity: int, open_windows: int) -> Iterator[pd.DataFrame]:
    cache, packer, held = common.only(_word_ids(path)), Packer(capacity, open_windows), []
    base = TaskContext.get().partitionId() << PARTITION_SHIFT
    end = array("I", [END_ID]).tobytes()
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            parts = cache.split(b"" if text is None else text.encode("utf-8", "surrogatepass"))
            ids = b"".join(map(cache.__getitem__, parts)) + end
            total = len(ids) // 4
            for start in range(0, total, capacity):
                length = min(capacity, total - start)
                window, offset, _ = packer.place(length)
                held.append((None if pd.isna(doc_id) else int(doc_id), start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, base + window, offset))
        # rows of windows that are no longer open can go; the others wait for their window
        still = {base + w for w in packer.open()}
        done = [r for r in held if r[5] not in still]
        held = [r for r in held if r[5] in still]
        if done:
            yield _rows(done, False)
            for w in {r[5] - base for r in done}:
                packer.filled.pop(w, None)
    if held:
        yield _rows(held, True)


def _rows(rows: list[tuple], is_open: bool) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "window", "offset"])
    out["doc_id"] = out["doc_id"].astype("Int64")
    out["filled"] = out.groupby("window")["length"].transform("sum")
    out["open"] = is_open
    return out


def _merge_group(key, frame: pd.DataFrame, capacity: int, open_windows: int) -> pd.DataFrame:
    """Best fit of whole leftover windows, the fullest first, within one group of at most ``fan_in`` partitions."""
    frame = frame.sort_values(["filled", "window"], ascending=[False, True])
    packer, slots, shifts, names = Packer(capacity, open_windows), [], [], {}
    for window, filled in zip(frame["window"], frame["filled"]):
        slot, offset, _ = packer.place(int(filled))
        names.setdefault(slot, int(window))
        slots.append(slot)
        shifts.append(offset)
    still = packer.open()
    return pd.DataFrame(
        {
            "grp": np.full(len(frame), int(key[0]), dtype="int64"),
            "old": frame["window"].to_numpy("int64"),
            "new": np.array([names[s] for s in slots], dtype="int64"),
            "by": np.array(shifts, dtype="int64"),
            "still": np.array([s in still for s in slots], dtype=bool),
        }
    )


def pack(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    capacity: int = CAPACITY,
    open_windows: int = OPEN_WINDOWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Pack ``docs(doc_id, text)``; one row per piece with its sequence and its place there."""
    spark = docs.sparkSession
    common.ship(spark)
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        functools.partial(_pack_partition, path=path, capacity=capacity, open_windows=open_windows), PIECES
    )
    packed = common.stage(pieces, "packed")
    # windows left open: a bounded number for each partition, and two numbers for each window
    left = packed.where("open").groupBy("window").agg(F.max("filled").alias("filled"))
    moves = left.select(
        "window", "filled", F.col("window").alias("target"), F.lit(0).cast("long").alias("shift"), F.shiftright("window", PARTITION_SHIFT).alias("part"), F.lit(True).alias("live")
    )
    last = moves.agg(F.max("part")).first()[0]
    groups = 0 if last is None else int(last) + 1

    def merge(key, frame: pd.DataFrame) -> pd.DataFrame:
        return _merge_group(key, frame, capacity, open_windows)

    while groups:
        groups = -(-groups // fan_in)
        heads = moves.where("live").withColumn("part", F.expr(f"part div {fan_in}"))
        heads = heads.groupBy("part", F.col("target").alias("window")).agg(F.max(F.col("shift") + F.col("filled")).alias("filled"))
        merged = heads.groupBy("part").applyInPandas(merge, "grp long, old long, new long, by long, still boolean")
        moves = common.stage(
            moves.join(merged, F.col("live") & (F.col("target") == F.col("old")), "left").select(
                "window",
                "filled",
                F.coalesce("new", "target").alias("target"),
                (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift"),
                F.coalesce("grp", "part").alias("part"),
                F.coalesce("still", F.lit(False)).alias("live"),
            ),
            "moves",
        )
        if groups == 1:
            break
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    early = packed.where("not open").select(*cols, F.col("window").alias("sequence_id"), "offset")
    late = packed.where("open").join(moves.select("window", "target", "shift"), "window")
    return early.unionByName(late.select(*cols, F.col("target").alias("sequence_id"), (F.col("shift") + F.col("offset")).alias("offset")))

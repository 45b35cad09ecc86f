"""Byte-level BPE by recursive queries: encode with the ranks of a vocabulary file, decode by ordered aggregation.

A text is split by the vocabulary's pattern; the words so found are encoded each on its own. Each Python worker
keeps a DuckDB database with the vocabulary and the merge table (every pair of tokens whose bytes joined are a token,
with its rank). The new words of a batch of texts go in as rows; a recursive query lays out their token positions,
joins neighbouring tokens to the merge table and contracts each word's leftmost pair of least rank, until no word has
a pair left. Decoding joins token positions to the vocabulary and aggregates the bytes in order. Words are remembered
between batches up to a fixed number, which changes no result.

Two things keep long words, such as whole phrases of scripts without spaces, from taking many steps. Where no token
can span two neighbouring bytes, because none holds them with what stands around them, a word falls into parts that
are encoded each on its own. And a step contracts, in every stretch of a long part, its pairs of least rank, if neither
neighbouring stretch has a lower one. A stretch is more than twice as long as the longest token: a token that grows
into a stretch from outside cannot reach the pair before the pair is contracted, so the pair would be contracted with
the same two tokens if the pairs of the whole word took turns. Of pairs of one rank that overlap every other one is
contracted, from the left; where the token made can go into a pair of lower rank still, only the leftmost is.

Cases: a null text counts as empty; an empty text has no tokens, and its digests are those of the empty string; very
long words are encoded whole; repeated documents get one row each; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections import ChainMap
from collections.abc import Iterator

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words, and parts of words, remembered by a worker, the longest remembered, and words in one query.
REMEMBERED, LONGEST, AT_ONCE = 600_000, 48, 40_000
#: Characters of text that are looked up at once.
AT_A_TIME = 6_000_000

ENCODE = """
WITH RECURSIVE step(word, toks) USING KEY (word) AS (
    SELECT word, toks FROM fresh
  UNION
    SELECT s.word, s.toks[:b.place - 1] || [b.made] || s.toks[b.place + 2:]
    FROM step AS s JOIN (
        SELECT word, (least % {places})::INT AS place, (least // {places})::INT AS made
        FROM (
            SELECT p.word, min(m.made::BIGINT * {places} + p.place) AS least
            FROM (SELECT word, unnest(range(1, len(toks))) AS place, unnest(toks[:-2]) AS a, unnest(toks[2:]) AS b FROM step) AS p
            JOIN merges AS m ON m.a = p.a AND m.b = p.b
            GROUP BY p.word
        )
    ) AS b ON b.word = s.word
)
SELECT word, toks FROM step
""".format(places=1 << 31)

# Words longer than a stretch: the same step for every stretch that has no lower pair beside it.
ENCODE_LONG = """
WITH RECURSIVE step(word, toks) USING KEY (word) AS (
    SELECT word, toks FROM fresh
  UNION
    SELECT word, list(made ORDER BY place)
    FROM (
        WITH tok AS (SELECT word, unnest(range(1, len(toks) + 1)) AS place, unnest(toks) AS tok, unnest(list_append(toks[2:], -1)) AS following FROM step),
        pair AS (SELECT t.word, t.place, t.place // {{stretch}} AS part, m.made FROM tok AS t JOIN merges AS m ON m.a = t.tok AND m.b = t.following),
        low AS (SELECT word, part, min(made) AS made, min(made::BIGINT * {places} + place) AS least FROM pair GROUP BY word, part),
        ready AS (SELECT x.word, x.part, x.made, x.least % {places} AS place, x.made IN (SELECT token FROM alone) AS single,
                coalesce(a.made >= x.made, true) AND coalesce(b.made >= x.made, true) AS free,
                coalesce(a.least > x.least, true) AND coalesce(b.least > x.least, true) AS lowest
            FROM low AS x LEFT JOIN low AS a ON a.word = x.word AND a.part = x.part - 1 LEFT JOIN low AS b ON b.word = x.word AND b.part = x.part + 1),
        hit AS (SELECT p.word, p.place, p.made, r.free, r.single, r.lowest AND p.place = r.place AS first,
                p.place - row_number() OVER (PARTITION BY p.word, p.made ORDER BY p.place) AS run
            FROM pair AS p JOIN ready AS r ON r.word = p.word AND r.part = p.part AND r.made = p.made),
        chosen AS (SELECT word, place, made
            FROM (SELECT *, row_number() OVER beside AS nth, bool_and(free) OVER beside AS undisturbed FROM hit WINDOW beside AS (PARTITION BY word, made, run ORDER BY place))
            WHERE CASE WHEN single THEN first ELSE undisturbed AND nth % 2 = 1 END)
        SELECT t.word, t.place, coalesce(c.made, t.tok) AS made
        FROM tok AS t LEFT JOIN chosen AS c ON c.word = t.word AND c.place = t.place LEFT JOIN chosen AS g ON g.word = t.word AND g.place = t.place - 1
        WHERE g.place IS NULL AND t.word IN (SELECT word FROM chosen)
    )
    GROUP BY word
)
SELECT word, toks FROM step
""".format(places=1 << 31)

DECODE = """
SELECT t.word, string_agg(v.hex, '' ORDER BY t.place) AS hex
FROM (SELECT word, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS place FROM coded) AS t
JOIN vocabulary AS v ON v.token = t.tok
GROUP BY t.word
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_rows(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(left, right, joined) for every token that two other tokens make; the joined token's id is its rank."""
    return [
        (ranks[token[:i]], ranks[token[i:]], rank)
        for token, rank in ranks.items()
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]


class Joints:
    """Which neighbouring bytes of a word some token may span.

    A token of two or three bytes spans them as it is; a longer one has four bytes in a row around them, and these
    are looked up by a hash: where it errs, bytes count as joined that are not, which costs time only."""

    BITS = 24

    def __init__(self, tokens: list[bytes]):
        self.two = np.zeros(1 << 16, dtype=bool)
        self.three, self.four = np.zeros(1 << self.BITS, dtype=bool), np.zeros(1 << self.BITS, dtype=bool)
        for size, table in ((2, self.two), (3, self.three)):
            table[self._grams(np.frombuffer(b"".join(t for t in tokens if len(t) == size), dtype=np.uint8), size)[::size]] = True
        for t in tokens:
            if len(t) > 3:
                self.four[self._grams(np.frombuffer(t, dtype=np.uint8), 4)] = True

    def _grams(self, x: np.ndarray, size: int) -> np.ndarray:
        """A number below 2**BITS for every ``size`` bytes in a row."""
        n = max(0, len(x) - size + 1)
        out = np.zeros(n, dtype=np.uint32)
        for i in range(size):
            out = (out << np.uint32(8)) | x[i : i + n]
        return (out * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.BITS) if size == 4 else out

    def between(self, x: np.ndarray) -> np.ndarray:
        """For every two neighbours among the bytes ``x`` whether they are joined."""
        out = self.two[self._grams(x, 2)]
        for size, table in ((3, self.three), (4, self.four)):
            hit = table[self._grams(x, size)]
            for i in range(size - 1):  # a hit joins all bytes inside
                out[i : i + len(hit)] |= hit
        return out


class Codec:
    """A vocabulary in a private in-memory database."""

    def __init__(self, ranks_path: str, pattern: str):
        self.ranks = load_ranks(ranks_path)
        self.split = regex.compile(pattern).findall
        self.byte_token = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.joints = Joints(list(self.ranks))
        self.stretch = 2 * max(map(len, self.ranks)) + 4
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "1GB", "preserve_insertion_order": False, "temp_directory": ""})
        rows = merge_rows(self.ranks)
        merges = pa.table({n: pa.array([r[i] for r in rows], pa.int32()) for i, n in enumerate(("a", "b", "made"))})
        vocabulary = pa.table({"token": pa.array(list(self.ranks.values()), pa.int32()), "hex": [k.hex() for k in self.ranks]})
        # tokens that can go into a token of lower rank than their own
        alone = pa.table({"token": pa.array(sorted({part for *parts, made in rows for part in parts if made < part}), pa.int32())})
        for name, table in (("merges", merges), ("vocabulary", vocabulary), ("alone", alone)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        #: word -> (ids in decimal joined by commas, bytes decoded from the ids)
        self.words: dict[str, tuple[str, bytes]] = {}
        #: part of a word -> its ids
        self.parts: dict[bytes, list[int]] = {}

    def parts_of(self, found: list[bytes]) -> list[list[bytes]]:
        """Each word cut where no token can span two bytes."""
        ends = np.cumsum([len(w) for w in found], dtype=np.int64)
        whole = b"".join(found)
        joined = self.joints.between(np.frombuffer(whole, dtype=np.uint8))
        joined[ends[:-1] - 1] = False
        cuts = [*(np.flatnonzero(~joined) + 1).tolist(), len(whole)]
        out, at, k = [], 0, 0
        for end in ends.tolist():
            own = []
            while at < end:
                own.append(whole[at : cuts[k]])
                at, k = cuts[k], k + 1
            out.append(own)
        return out

    def encode_words(self, found: list[bytes]) -> list[list[int]]:
        """Token ids of each word; a word that is a token is that token."""
        out = [[self.ranks[w]] if w in self.ranks else [] for w in found]
        for k in range(0, len(found), AT_ONCE):
            todo = [i for i in range(k, min(k + AT_ONCE, len(found))) if found[i] and found[i] not in self.ranks]
            if not todo:
                continue
            split = self.parts_of([found[i] for i in todo])
            new = {p for parts in split for p in parts}.difference(self.parts)
            if len(self.parts) + len(new) > REMEMBERED:
                self.parts.clear()
                new = {p for parts in split for p in parts}
            extra = dict(zip(new, self._encode_parts(list(new))))
            # a word that is one part is remembered with the words
            self.parts.update((p, extra[p]) for parts in split if len(parts) > 1 for p in parts if p in extra and len(p) <= LONGEST)
            known = ChainMap(extra, self.parts)
            for i, parts in zip(todo, split):
                out[i] = known[parts[0]] if len(parts) == 1 else [t for p in parts for t in known[p]]
        return out

    def _encode_parts(self, found: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[int(self.byte_token[w[0]])] if len(w) == 1 else [] for w in found]
        for short in (True, False):
            todo = [i for i, w in enumerate(found) if len(w) > 1 and (len(w) <= self.stretch) == short]
            for k in range(0, len(todo), AT_ONCE):
                part = todo[k : k + AT_ONCE]
                offsets = np.cumsum([0, *[len(found[i]) for i in part]], dtype=np.int32)
                tokens = self.byte_token[np.frombuffer(b"".join([found[i] for i in part]), dtype=np.uint8)]
                start = pa.table({"word": pa.array(part, pa.int32()), "toks": pa.ListArray.from_arrays(offsets, tokens)})
                self.db.register("fresh", start)
                coded = self.db.sql(ENCODE if short else ENCODE_LONG.format(stretch=self.stretch)).to_arrow_table()
                for word, toks in zip(coded["word"].to_pylist(), coded["toks"].to_pylist()):
                    out[word] = toks
        return out

    def decode_words(self, coded: list[list[int]]) -> list[bytes]:
        """The bytes of each list of ids."""
        out = [b""] * len(coded)
        for k in range(0, len(coded), AT_ONCE):
            part = coded[k : k + AT_ONCE]
            self.db.register("coded", pa.table({"word": pa.array(range(k, k + len(part)), pa.int32()), "toks": pa.array(part, pa.list_(pa.int32()))}))
            found = self.db.sql(DECODE).to_arrow_table()
            for word, text in zip(found["word"].to_pylist(), found["hex"].to_pylist()):
                out[word] = bytes.fromhex(text)
        return out

    def lookup(self, found: set[str]) -> dict[str, tuple[str, bytes]]:
        """Encode and decode the words that are not remembered; those too long to remember are returned."""
        new = found.difference(self.words)
        if len(self.words) + len(new) > REMEMBERED:
            self.words.clear()
            new = found
        new = list(new)
        coded = self.encode_words([w.encode("utf-8", "surrogatepass") for w in new])
        extra = {}
        for w, ids, text in zip(new, coded, self.decode_words(coded)):
            (self.words if len(w) <= LONGEST else extra)[w] = (",".join(map(str, ids)), text)
        return extra


@functools.lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _slices(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of about AT_A_TIME characters; a longer text is a run of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > AT_A_TIME:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def _digest(batches: Iterator[pd.DataFrame], path: str, pattern: str) -> Iterator[pd.DataFrame]:
    codec = _codec(path, pattern)
    if common.only(codec.words) is codec.words and not codec.words:
        codec.parts.clear()
    for batch in batches:
        texts = ["" if t is None else t for t in batch["text"]]
        for at in _slices(texts):
            split = [codec.split(t) for t in texts[at]]
            extra = codec.lookup(set().union(*split))
            known = ChainMap(codec.words, extra) if extra else codec.words
            rows = []
            for doc_id, found in zip(batch["doc_id"].iloc[at], split):
                coded = [known[w] for w in found]
                ids = ",".join([c[0] for c in coded])
                text = b"".join([c[1] for c in coded])
                rows.append((doc_id, ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
            out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out


def _encode(batches: Iterator[pd.DataFrame], path: str, pattern: str) -> Iterator[pd.DataFrame]:
    codec = _codec(path, pattern)
    for batch in batches:
        split = [codec.split("" if t is None else t) for t in batch["text"]]
        number = {w: i for i, w in enumerate(set().union(*split))}
        coded = codec.encode_words([w.encode("utf-8", "surrogatepass") for w in number])
        out = batch.drop(columns="text")
        out["ids"] = [[t for w in found for t in coded[number[w]]] for found in split]
        yield out


def _decode(batches: Iterator[pd.DataFrame], path: str, pattern: str) -> Iterator[pd.DataFrame]:
    codec = _codec(path, pattern)
    for batch in batches:
        out = batch.drop(columns="ids")
        out["bytes"] = codec.decode_words([[] if ids is None else [int(i) for i in ids] for ids in batch["ids"]])
        yield out


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``(doc_id, ids)`` for ``docs(doc_id, text)``."""
    common.ship(docs.sparkSession)
    path = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return _rows(docs, "text").mapInPandas(functools.partial(_encode, path=path, pattern=pattern), "doc_id long, ids array<int>")


def decode(coded: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``(doc_id, bytes)`` for ``coded(doc_id, ids)``; null ids give no bytes, unknown ids are skipped."""
    common.ship(coded.sparkSession)
    path = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return _rows(coded, "ids").mapInPandas(functools.partial(_decode, path=path, pattern=pattern), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encode every text, decode its ids again, and return counts and digests of both."""
    common.ship(docs.sparkSession)
    path = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return _rows(docs, "text").mapInPandas(
        functools.partial(_digest, path=path, pattern=pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _rows(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), column)

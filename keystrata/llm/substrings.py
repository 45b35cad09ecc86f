"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A window is ``width`` consecutive words of one text. A word goes if some window that covers it also starts in a row
with a smaller doc_id. Windows are named by two independent 64-bit polynomial hashes of their words' 128-bit hashes,
both computed for every start of a text from running sums; repeated windows are found by grouping on these names, and
the windows of a text that must go merge into maximal intervals of words.

Two steps keep the grouping small without leaving a window out. Equal word sequences are grouped first: the row of
smallest doc_id speaks for all, and in the others every window is a repeat. Then every text emits, for each run of
consecutive shorter word sequences inside a window, only the one of least hash. A window that occurs in two texts has
the same least one in both, so only windows whose least sequence occurs in two texts can be repeats; these, and no
others, are named and counted.

Cases: a null text counts as empty; texts shorter than a window lose nothing; of rows with the same doc_id none is
smaller, so they do not remove each other's words; a null doc_id takes part as larger than every other and such rows
leave each other alone; very long texts are worked through whole; an empty table gives no rows; other columns are kept
by ``remove_repeats`` and ignored by ``digest``.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, only, passing, sent_if_small, ship, spread_join, stage, tidy
from .quality_rules import let

#: Words in a window, and words in the shorter sequences that find the windows worth naming.
WIDTH, ANCHOR = 50, 16
#: Odd multipliers of the polynomials.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Words whose hashes a worker remembers.
REMEMBERED = 100_000
#: doc_id of rows without one, larger than every other.
NO_ID = (1 << 63) - 1


class _Hashes(dict):
    """128-bit hash of a word, 16 bytes."""

    def __missing__(self, word: bytes) -> bytes:
        h = xxhash.xxh3_128_digest(word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = h
        return h


_hashes = _Hashes()


def word_hashes(parts: list[bytes]) -> np.ndarray:
    """One row of two unsigned 64-bit numbers for each word."""
    return np.frombuffer(b"".join(map(_hashes.__getitem__, parts)), dtype="<u8").reshape(-1, 2)


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


@functools.lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < size."""
    out = []
    for factor in (base, pow(base, -1, 1 << 64)):
        factors = np.full(size, factor, dtype=np.uint64)
        factors[0] = 1
        out.append(np.cumprod(factors, dtype=np.uint64))
    return out[0], out[1]


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of every ``width`` consecutive values, modulo 2**64."""
    n = len(values)
    if n < width:
        return np.empty(0, dtype=np.uint64)
    up, down = _powers(base, 1 << max(10, n.bit_length()))
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values * up[:n], dtype=np.uint64)))
        return (sums[width:] - sums[:-width]) * down[: n - width + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits, so that the least of some hashes is a random one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def least_of_runs(x: np.ndarray, run: int) -> np.ndarray:
    """Minimum of every ``run`` consecutive values, by doubling."""
    if len(x) < run:
        return np.empty(0, dtype=x.dtype)
    span = 1
    out = x
    while span * 2 <= run:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = run - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors_of(low: np.ndarray, width: int, anchor: int) -> np.ndarray:
    """For every window its least anchor hash."""
    return least_of_runs(mix(rolling(low, anchor, BASES[0])), width - anchor + 1)


@tidy
def _survey(batches: Iterator[pd.DataFrame], width: int, anchor: int) -> Iterator[pd.DataFrame]:
    """For each row its words' number and digest, a 128-bit name of its word sequence, and its distinct least anchors."""
    only(_hashes)
    for batch in batches:
        rows = []
        for doc_id, k, text in zip(batch["doc_id"], batch["k"], batch["text"]):
            parts = encoded(text).split()
            whole = hashlib.sha256(b" ".join(parts))
            name, found = whole.digest(), []
            if len(parts) >= width:
                found = np.unique(anchors_of(word_hashes(parts)[:, 0], width, anchor)).view(np.int64)
            c1, c2 = (int.from_bytes(name[i : i + 8], "little", signed=True) for i in (0, 8))
            rows.append((doc_id, k, len(parts), whole.hexdigest(), c1, c2, found))
        yield pd.DataFrame(rows, columns=["doc_id", "k", "n_words", "kept_sha256", "c1", "c2", "anchors"])


@tidy
def _windows(batches: Iterator[pd.DataFrame], width: int, anchor: int) -> Iterator[pd.DataFrame]:
    """Names and places of the windows whose least anchor is among the row's shared ones."""
    only(_hashes)
    for batch in batches:
        for doc_id, k, text, shared in zip(batch["doc_id"], batch["k"], batch["text"], batch["shared"]):
            hashes = word_hashes(encoded(text).split())
            a = anchors_of(hashes[:, 0], width, anchor).view(np.int64)
            at = np.flatnonzero(np.isin(a, np.asarray(shared, dtype="int64")))
            if not len(at):
                continue
            h1, h2 = (rolling(hashes[:, i], width, BASES[i]).view(np.int64) for i in (0, 1))
            for i in range(0, len(at), 100_000):
                part = at[i : i + 100_000]
                yield pd.DataFrame({"h1": h1[part], "h2": h2[part], "doc_id": np.int64(doc_id), "k": np.int64(k), "at": part.astype("int32")})


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key: the id, NO_ID where there is none, and a hash of the text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("k"), "text")


def merged(starts: Column, width: int) -> Column:
    """Maximal intervals of words, as pairs of first word and end, that windows at these sorted starts cover."""
    first = F.filter(starts, lambda x, i: F.coalesce(x > F.get(starts, i - 1) + width, F.lit(True)))
    last = F.filter(starts, lambda x, i: F.coalesce(F.get(starts, i + 1) > x + width, F.lit(True)))
    return F.zip_with(first, last, lambda a, b: F.array(a, b + width))


def repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What each row has, ``(doc_id, k, n_words, kept_sha256)``; the rows of which every window goes, ``(doc_id, k)``;
    the texts that share anchors, ``(doc_id, k, text)``; and the intervals of words that go of some, ``(doc_id, k, cuts)``.

    Texts are read twice; they are shuffled to meet their shared anchors only if these are too many to send to every
    task. All else that moves are digests, anchors and the windows worth naming."""
    ship(docs.sparkSession)
    rows = _keyed(docs)
    survey = rows.mapInPandas(
        functools.partial(_survey, width=width, anchor=anchor),
        "doc_id long, k long, n_words long, kept_sha256 string, c1 long, c2 long, anchors array<long>",
    )
    survey = stage(survey, "survey")
    long = survey.where(F.col("n_words") >= width)
    # rows that repeat a smaller row whole: every window of theirs starts there too
    first = long.groupBy("c1", "c2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    first = stage(first.select("c1", "c2", "first"), "first")
    copies = stage(long.select("doc_id", "k", "c1", "c2").join(first, ["c1", "c2"]).where("doc_id > first").select("doc_id", "k").distinct(), "copies")
    anchors = long.join(copies, ["doc_id", "k"], "left_anti").select("doc_id", "k", F.explode("anchors").alias("a"))
    # an anchor of one id only is no repeat across rows
    shared = anchors.groupBy("a").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    shared = stage(shared.select("a", "n"), "shared")
    wanted = stage(spread_join(anchors, shared.select("a"), "a", counts=shared).groupBy("doc_id", "k").agg(F.collect_set("a").alias("shared")), "wanted")
    candidates = stage(rows.join(sent_if_small(wanted, 32 + 8 * F.size("shared")), ["doc_id", "k"]), "candidates")
    windows = candidates.mapInPandas(functools.partial(_windows, width=width, anchor=anchor), "h1 long, h2 long, doc_id long, k long, at int")
    windows = stage(windows, "windows")
    least = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    least = stage(least.select("h1", "h2", "lo", "n"), "least")
    gone = spread_join(windows, least.drop("n"), ["h1", "h2"], counts=least).where("doc_id > lo").groupBy("doc_id", "k").agg(F.sort_array(F.collect_set("at")).alias("starts"))
    gone = stage(gone.select("doc_id", "k", let(F.col("starts"), lambda s: merged(s, width)).alias("cuts")), "gone")
    return survey.select("doc_id", "k", "n_words", "kept_sha256"), copies, candidates.select("doc_id", "k", "text"), gone


@tidy
def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    only(_hashes)
    for batch in batches:
        rows = []
        for doc_id, k, text, cuts in zip(batch["doc_id"], batch["k"], batch["text"], batch["cuts"]):
            parts = encoded(text).split()
            keep, at = [], 0
            for a, b in cuts:
                keep += parts[at:a]
                at = b
            keep += parts[at:]
            rows.append((doc_id, k, len(parts) - len(keep), hashlib.sha256(b" ".join(keep)).hexdigest()))
        yield pd.DataFrame(rows, columns=["doc_id", "k", "n_removed", "sha"])


def digest(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """Word counts and a digest of the kept words of each row of ``docs(doc_id, text)``."""
    survey, copies, texts, gone = repeats(docs, width, anchor)
    cut = texts.join(sent_if_small(gone, 32 + 32 * F.size("cuts")), ["doc_id", "k"])
    lost = cut.mapInPandas(_kept, "doc_id long, k long, n_removed long, sha string").distinct()
    lost = lost.unionByName(copies.select("doc_id", "k", F.lit(None).cast("long").alias("n_removed"), F.sha2(F.lit("").cast("binary"), 256).alias("sha")))
    return survey.join(stage(lost, "lost"), ["doc_id", "k"], "left").select(
        F.when(F.col("doc_id") < NO_ID, F.col("doc_id")).alias("doc_id"),
        "n_words",
        F.when(F.col("sha").isNull(), F.lit(0)).otherwise(F.coalesce("n_removed", "n_words")).cast("long").alias("n_removed"),
        F.coalesce("sha", "kept_sha256").alias("kept_sha256"),
    )


_WORD = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def cut_text(text: str, covered: list[tuple[int, int]]) -> str:
    """The text without the covered words and the white space after each; other characters stay as they are."""
    if not covered:
        return text
    ends, starts = [], []
    for m in _WORD.finditer(text):
        starts.append(m.start())
        ends.append(m.end())
    out, at = [], 0
    for a, b in covered:
        out.append(text[at : starts[a]])
        at = ends[b - 1]
    out.append(text[at:])
    return "".join(out)


@tidy
def _remove(batches: Iterator[pa.RecordBatch], whole: str, cuts: str) -> Iterator[pa.RecordBatch]:
    only(_hashes)
    for batch in batches:
        place = batch.schema.get_field_index("text")
        texts = []
        for text, every, some in zip(*(batch.column(c).to_pylist() for c in ("text", whole, cuts))):
            if text is not None and every:
                text = cut_text(text, [(0, len(encoded(text).split()))])
            elif text is not None and some is not None:
                text = cut_text(text, some)
            texts.append(text)
        out = batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))
        yield out.drop_columns([whole, cuts])


def remove_repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with the repeated words cut out of ``text``; all columns stay, whatever their names."""
    whole, cuts, i, k = fresh(docs.columns, "whole", "cuts", "id", "key")
    none = F.lit(None).cast("array<array<int>>")
    ids = [F.col("doc_id").alias(i), F.col("k").alias(k)]
    with passing(docs.sparkSession) as keep:
        _, copies, _, gone = repeats(docs, width, anchor)
        marks = gone.select(*ids, F.lit(False).alias(whole), F.col("cuts").alias(cuts))
        marks = keep(marks.unionByName(copies.select(*ids, F.lit(True).alias(whole), none.alias(cuts))), "marks")
    marks = sent_if_small(marks, 32 + 32 * F.coalesce(F.size(cuts), F.lit(0)))
    match = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == marks[i]) & (F.xxhash64(docs["text"]) == marks[k])
    marked = docs.join(marks, match, "left").drop(i, k)
    return marked.mapInArrow(functools.partial(_remove, whole=whole, cuts=cuts), docs.schema)


#: ``digest`` in DuckDB: windows as strings, counted by a window function.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\f\r]+') AS words FROM documents),
w AS (SELECT r, doc_id, j, array_to_string(words[j:j + 49], ' ') AS win FROM (SELECT *, unnest(range(1, len(words) - 48)) AS j FROM d WHERE len(words) >= 50)),
m AS (SELECT r, doc_id, j, min(doc_id) OVER (PARTITION BY win) AS first FROM w),
gone AS (SELECT DISTINCT r, unnest(range(j, j + 50)) AS p FROM m WHERE first < doc_id),
keep AS (SELECT d.r, p.p, d.words[p.p] AS word FROM d, LATERAL (SELECT unnest(range(1, len(d.words) + 1)) AS p) AS p ANTI JOIN gone ON gone.r = d.r AND gone.p = p.p),
k AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM keep GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

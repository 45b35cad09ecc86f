"""SimHash near-duplicate groups by covering locality-sensitive hashing.

A fingerprint has 64 bits; bit b is set if it is set in over half of the 64-bit hashes of the text's word shingles.
Two fingerprints link if they differ in at most ``radius`` bits. A random map sends each bit to a vector of
``radius + 1`` bits; each of the ``2**(radius + 1) - 1`` other non-zero vectors v gives a mask, of the bits whose
vector has an odd inner product with v. Whatever ``radius`` bits two fingerprints differ in, some mask leaves all of
them out, so the pair is equal under that mask: every pair within the radius meets in some table.

Only distinct fingerprints are linked. Inside a bucket, pairs are compared where the bucket is small. In a larger
one, every fingerprint is sent to its neighbourhood instead: to all points that differ from it in at most two of the
bits outside the mask, marked with the number of bits. Where a point has a fingerprint at one bit or less, all that
are there lie within three bits of that one and link to it; and any two fingerprints within three bits meet at such a
point. The work is in proportion to the bucket's size, and no pairs of a group are listed.

Cases: a null text counts as empty; a text without words has fingerprint zero and links like any other; fewer words
than a shingle make one shingle of all words; a group's id is its smallest doc_id; a null doc_id takes no part as
id, it gets the group of its fingerprint; repeated rows stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, ship, spread_join, stage, tidy

BITS, RADIUS, SEED = 64, 3, 42
#: Buckets of up to so many fingerprints are compared pair by pair.
SMALL_BUCKET = 32
#: Shingles whose hash bits are counted at once.
AT_ONCE = 1 << 17


def fingerprint_of(text: bytes, width: int) -> int:
    """The fingerprint of UTF-8 text, A-Z lower-cased."""
    parts = text.lower().split()
    if not parts:
        return 0
    whole = memoryview(b" ".join(parts))
    if len(parts) <= width:
        return _majority(np.array([xxhash.xxh64_intdigest(whole, SEED)], dtype="<u8"))
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(parts) - width + 1].tolist()
    ends = (ends - 1)[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return _majority(np.array([digest(whole[a:b], SEED) for a, b in zip(starts, ends)], dtype="<u8"))


def _majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), AT_ONCE):
        part = hashes[i : i + AT_ONCE]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        prints = [fingerprint_of(b"" if t is None else t.encode("utf-8", "surrogatepass"), width) for t in batch["text"]]
        out = batch.drop(columns="text")
        out["doc_id"] = out["doc_id"].astype("Int64")
        out["print"] = np.array(prints, dtype="uint64").view("int64")
        yield out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, print)`` of ``docs(doc_id, text)``; the 64 bits as a signed long."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(functools.partial(_fingerprints, width=width), "doc_id long, print long")


def masks(radius: int = RADIUS, seed: int = 7) -> list[int]:
    """The covering masks, as signed longs. Every bit's vector is used about equally often, in random order."""
    size = 1 << (radius + 1)
    to = np.random.default_rng(seed).permutation([1 + i % (size - 1) for i in range(BITS)])
    out = []
    for v in range(1, size):
        mask = sum(1 << bit for bit in range(BITS) if bin(int(to[bit]) & v).count("1") % 2)
        out.append(int(np.array([mask], dtype="uint64").view("int64")[0]))
    return out


@tidy
def _neighbourhood(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Each fingerprint at every point that differs in at most ``radius - 1`` of the bits outside its mask.

    For radius 3: points at up to two bits. ``near`` says whether the point is at ``radius // 2`` bits or less."""
    tables = {}
    for mask in masks(radius):
        free = [b for b in range(BITS) if not (mask >> b) & 1]
        flips = [sum(1 << b for b in c) for n in range((radius + 1) // 2 + 1) for c in combinations(free, n)]
        tables[mask] = (np.array(flips, dtype="uint64").view("int64"), np.array([bin(f).count("1") <= radius // 2 for f in flips]))
    for batch in batches:
        for mask, part in batch.groupby("mask"):
            flips, near = tables[int(mask)]
            step = max(1, 200_000 // len(flips))
            prints = part["print"].to_numpy("int64")
            for i in range(0, len(prints), step):
                p = prints[i : i + step]
                yield pd.DataFrame({"point": (p[:, None] ^ flips[None, :]).ravel(), "print": np.repeat(p, len(flips)), "near": np.tile(near, len(p))})


def links(prints: DataFrame, radius: int = RADIUS, small: int = SMALL_BUCKET) -> DataFrame:
    """Edges ``(u, v)`` whose components are those of all pairs of ``prints(print)`` within ``radius`` bits."""
    table = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).alias("m")) for i, m in enumerate(masks(radius))])
    rows = prints.select("print").withColumn("x", F.explode(table))
    rows = rows.select("print", F.col("x.t").alias("t"), F.col("x.m").alias("mask"), F.col("print").bitwiseAND(F.col("x.m")).alias("bucket"))
    sizes = rows.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = stage(rows.join(sizes, ["t", "bucket"]), "buckets")
    few = met.where(F.col("n") <= small)
    a, b = few.select("t", "bucket", F.col("print").alias("u")), few.select("t", "bucket", F.col("print").alias("v"))
    pairs = a.join(b, ["t", "bucket"]).where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)).select("u", "v").distinct()
    many = met.where(F.col("n") > small).select("print", "mask")
    if many.isEmpty():
        return pairs
    points = many.mapInPandas(functools.partial(_neighbourhood, radius=radius), "point long, print long, near boolean")
    points = points.groupBy("point", "print").agg(F.max("near").alias("near"))
    points = stage(points, "points")
    heads = points.where("near").groupBy("point").agg(F.min("print").alias("head"))
    stars = points.join(heads, "point").where("print <> head").select(F.least("head", "print").alias("u"), F.greatest("head", "print").alias("v")).distinct()
    return pairs.unionByName(stars)


def groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, print, component_id)`` for ``prints(doc_id, print)``, which is read twice."""
    distinct = stage(prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "prints")
    roots = connected_components(links(distinct, radius), "simhash")
    labelled = distinct.join(roots, F.col("print") == F.col("u"), "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    labelled = stage(labelled, "labelled")
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = labelled.join(least, "root").select("print", "component_id")
    return spread_join(prints, of_print, "print", counts=distinct).select("doc_id", "print", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = RADIUS) -> DataFrame:
    """Fingerprint (16 hexadecimal digits) and group of each row of ``docs(doc_id, text)``."""
    prints = stage(fingerprints(docs, width), "fingerprints")
    found = groups(prints, radius)
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")

"""One document of each group of near copies: SimHash groups, widened to all pairs that are similar by their shingles.

Fingerprints of 64 bits that differ in at most three find copies with few changes, but not all texts that share four
fifths of their five-word shingles: such fingerprints differ in about ten bits. So there are further candidates, from
winnowed shingles: of every run of consecutive shingles a text gives the one of least hash, and short texts give their
few least. Each of these names a few hubs, the sets that come first in some fixed orders among those that have
it; a set is a candidate with the hubs of its shingles, where it shares a good part of them. This joins large groups
without listing their pairs, and may leave links out.

An exact join of what is not yet joined finds the rest. All shingles have one order, those that are frequent in a draw
of texts last, the others by their hash. Two sets of the wanted similarity share one of the first few shingles of each
(the prefix, a fifth of the set), are of nearly one size, and share no fewer prefix shingles than their rests can make
up for. All pairs of different groups that meet these bounds are compared; the order bears on the work only. Texts
are one without a comparison only if their shingle sets are equal.

Cases: a null text counts as empty; texts without words are one group; texts of fewer words than a shingle are one
shingle; the row of smallest doc_id stays, rows without an id come last and ties go by a hash of the text; of rows
equal in id and text one stays; an empty table gives no rows; all columns stay, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, drawn, fresh, only, passing, sent_if_small, ship, spread_join, stage, tidy, unstage
from .simhash import RADIUS, fingerprint_of, links
from .substrings import BASES, NO_ID, _hashes, least_of_runs, mix, rolling, word_hashes

WIDTH, SIMILARITY = 5, 0.8
#: Consecutive shingles of which one is given; shingles that a short text gives.
RUN, FEW = 32, 4
#: Orders in which hubs come first, beside that of the ids, and the part of its given shingles that a text must share with a hub.
SALTS, SHARED = (1, 2, 3, 4), 0.25
#: Sets drawn (about three times as many) to tell which shingles come last, and how many of these are told at most.
DRAWN, FREQUENT = 1000, 100_000
#: Pairs of one set that a task compares before they are dealt over several.
HUB = 1000
#: Groups that meet at a shingle for each of the parts that they are dealt into, and these parts at most.
MET, PARTS = 64, 64
#: Sets of one group meet others as one if their sizes are within about this factor.
CLASS = 1.05


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, A-Z lower-cased; of all words if there are fewer, nothing without words."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    hashes = word_hashes(parts)[:, 0]
    return mix(rolling(hashes, min(width, len(parts)), BASES[0]))


def given(hashes: np.ndarray) -> np.ndarray:
    """The winnowed shingles of a text."""
    if len(hashes) <= 2 * RUN:
        return np.unique(hashes)[:FEW]
    return np.unique(least_of_runs(hashes, RUN))


def name_of(hashes: np.ndarray) -> int:
    """A name of a text's whole shingle set, as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(np.unique(hashes).tobytes())).view(np.int64))


@tidy
def _survey(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    only(_hashes)
    for batch in batches:
        prints, names, found = [], [], []
        for t in batch["text"]:
            raw = b"" if t is None else t.encode("utf-8", "surrogatepass")
            prints.append(fingerprint_of(raw, width))
            hashes = shingle_hashes(raw, width)
            names.append(name_of(hashes))
            found.append(given(hashes).view(np.int64))
        out = batch.drop(columns="text")
        out["doc_id"] = out["doc_id"].astype("Int64")
        out["print"] = np.array(prints, dtype="uint64").view("int64")
        out["name"] = names
        out["given"] = found
        yield out


@tidy
def _sets(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    only(_hashes)
    for batch in batches:
        out = batch.drop(columns="text")
        out["shingles"] = [np.unique(shingle_hashes(b"" if t is None else t.encode("utf-8", "surrogatepass"), width)).view(np.int64) for t in batch["text"]]
        yield out


@tidy
def _shingles(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    only(_hashes)
    for batch in batches:
        for t in batch["text"]:
            yield pd.DataFrame({"g": np.unique(shingle_hashes(b"" if t is None else t.encode("utf-8", "surrogatepass"), width)).view(np.int64)})


def prefix_of(hashes: np.ndarray, frequent: np.ndarray, levels: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set of ``hashes`` in the order of all: eight bits of how frequent, then the hash.

    ``frequent`` is sorted and has ``levels`` from 1 to 127."""
    keys = hashes >> np.uint64(8)
    if len(frequent) and len(hashes):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        keys = keys | np.where(frequent[at] == hashes, levels[at], 0).astype(np.uint64) << np.uint64(56)
    keys.sort()
    return keys[: len(keys) - math.ceil(similarity * len(keys) - 1e-6) + 1]


@tidy
def _prefixes(batches: Iterator[pd.DataFrame], width: int, similarity: float, frequent: np.ndarray, levels: np.ndarray) -> Iterator[pd.DataFrame]:
    only(_hashes)
    for batch in batches:
        rows = []
        for t in batch["text"]:
            hashes = np.unique(shingle_hashes(b"" if t is None else t.encode("utf-8", "surrogatepass"), width))
            if len(hashes):
                prefix = prefix_of(hashes, frequent, levels, similarity).view(np.int64)
                rows.append((name_of(hashes), len(hashes), len(hashes) - len(prefix), prefix[-1], prefix))
        yield pd.DataFrame(rows, columns=["name", "n", "rest", "last", "prefix"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("k"), "text")


def _same_row(docs: DataFrame, ids: DataFrame) -> Column:
    return docs["doc_id"].cast("long").eqNullSafe(ids["__id"]) & (F.xxhash64(docs["text"]) == ids["__k"])


def candidates(speakers: DataFrame) -> DataFrame:
    """``(u, v)``: sets and hubs that share enough of what ``speakers(name, given)`` give."""
    rows = speakers.select("name", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.size("given").alias("n"), F.explode("given").alias("g"))
    orders = [F.col("id"), *[F.xxhash64("name", F.lit(salt)) for salt in SALTS]]
    first = [F.min(F.struct(o.alias("o"), "name", "n")).alias(f"h{i}") for i, o in enumerate(orders)]
    hubs = rows.groupBy("g").agg(F.count(F.lit(1)).alias("c"), *first).where("c > 1")
    hubs = stage(hubs.select("g", F.array_distinct(F.array(*[F.col(f"h{i}").dropFields("o") for i in range(len(orders))])).alias("hubs"), F.col("c").alias("n")), "hubs")
    met = spread_join(rows, hubs.drop("n"), "g", counts=hubs).select("name", "n", F.explode("hubs").alias("hub")).where(F.col("name") != F.col("hub.name"))
    pair = met.select(F.least("name", "hub.name").alias("u"), F.greatest("name", "hub.name").alias("v"), F.greatest("n", "hub.n").alias("most"), (F.col("name") < F.col("hub.name")).alias("side"))
    # a pair in which each is the other's hub counts the shingles twice, once for each side
    counts = pair.groupBy("u", "v", "most", "side").count().groupBy("u", "v", "most").agg(F.max("count").alias("shared"))
    return counts.where(F.col("shared") >= F.greatest(F.lit(1.0), SHARED * F.col("most"))).select("u", "v").distinct()


def print_links(first: DataFrame, radius: int) -> DataFrame:
    """``(u, v)``: candidates among ``first(name, print)`` by fingerprint; the least name of each stands for it and meets its others."""
    heads = stage(first.groupBy("print").agg(F.min("name").alias("head")), "heads")
    near = links(heads, radius)
    near = near.join(heads.select(F.col("print").alias("u"), F.col("head").alias("a")), "u").join(heads.select(F.col("print").alias("v"), F.col("head").alias("b")), "v")
    same = first.join(heads, "print").where("name <> head").select(F.col("head").alias("u"), F.col("name").alias("v"))
    return near.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).unionByName(same)


def frequent_shingles(docs: DataFrame, speakers: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of a draw of sets have, sorted, and a level of each that rises with its number."""
    some = speakers.where(drawn(F.col("name"), DRAWN, speakers.count())).select(F.col("doc_id").alias("__id"), F.col("k").alias("__k"))
    some = sent_if_small(stage(some, "drawn"), 32)
    texts = _keyed(docs)
    texts = texts.join(some, _same_row(texts, some), "left_semi").select("text")
    counts = texts.mapInPandas(functools.partial(_shingles, width=width), "g long").groupBy("g").count().where("count > 1")
    found = np.array([tuple(r) for r in counts.orderBy(F.desc("count"), "g").limit(FREQUENT).collect()], dtype=np.int64).reshape(-1, 2)
    shingles, order = found[:, 0].view(np.uint64), np.argsort(found[:, 0].view(np.uint64))
    return shingles[order], np.minimum(127, 4 * np.log2(found[:, 1])).astype(np.uint8)[order]


def missing_candidates(docs: DataFrame, survey: DataFrame, speakers: DataFrame, roots: DataFrame, width: int, similarity: float) -> DataFrame:
    """``(u, v)``: all pairs of sets of different groups in the staged ``roots(u, root)`` that can have the wanted similarity."""
    frequent, levels = frequent_shingles(docs, speakers, width)
    # the rows that do not speak for a set are fewer than those that do
    same = survey["doc_id"].eqNullSafe(speakers["doc_id"]) & (survey["k"] == speakers["k"])
    silent = survey.join(speakers, same, "left_anti").select(F.col("doc_id").alias("__id"), F.col("k").alias("__k")).distinct()
    silent = sent_if_small(stage(silent, "silent"), 32)
    texts = _keyed(docs)
    texts = texts.join(silent, _same_row(texts, silent), "left_anti").select("text")
    run = functools.partial(_prefixes, width=width, similarity=similarity, frequent=frequent, levels=levels)
    prefixes = stage(texts.mapInPandas(run, "name long, n int, rest int, last long, prefix array<long>"), "prefixes")
    roots = sent_if_small(roots, 24)
    named = prefixes.join(roots, F.col("name") == F.col("u"), "left").withColumn("root", F.coalesce("root", "name"))
    # a shingle within one group brings nothing
    given_ = named.select("name", "root", F.explode("prefix").alias("g"))
    shared = given_.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("g")
    shared = sent_if_small(stage(shared, "shared"), 16)
    # only ids and shingles move until the few that are shared are left
    met = stage(given_.select("name", "g").join(shared, "g").distinct(), "met-names")
    met = stage(met.join(named.drop("prefix", "u"), "name"), "met")
    unstage(prefixes)
    # groups meet first, their members of nearly one size as one, so that the members of one group never meet; where
    # many do, they are dealt into parts
    met = met.withColumn("class", F.floor(F.log("n") / math.log(CLASS)).cast("int"))
    heads = met.groupBy("g", "root", "class").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest"))
    heads = stage(heads, "met-heads")
    parts = heads.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    parts = stage(parts.select("g", "n", F.least(F.lit(PARTS), F.ceil(F.col("n") / MET)).cast("int").alias("parts")), "met-parts")
    heads = spread_join(heads, parts.drop("n"), "g", counts=parts)
    named_as = lambda x: [F.col("root").alias(f"r{x}"), F.col("class").alias(f"c{x}"), F.col("low").alias(f"l{x}"), F.col("high").alias(f"h{x}"), F.col("rest").alias(f"m{x}")]
    a = heads.select("g", F.pmod(F.xxhash64("root", "class"), "parts").cast("int").alias("part"), *named_as("a"))
    b = heads.select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *named_as("b"))
    near = (F.col("ha") >= similarity * F.col("lb") - 1e-6) & (F.col("hb") >= similarity * F.col("la") - 1e-6)
    both = ["ra", "ca", "rb", "cb"]
    groups = stage(a.join(b, ["g", "part"]).where((F.col("ra") < F.col("rb")) & near).drop("part"), "groups")
    # no two members share more prefix shingles than their groups do: most groups that meet go before their members are listed
    bound = F.count(F.lit(1)) + F.max(F.greatest("ma", "mb")) >= similarity / (1 + similarity) * (F.min("la") + F.min("lb")) - 1e-6
    able = groups.groupBy(*both).agg(bound.alias("able")).where("able").drop("able")
    groups = groups.join(sent_if_small(stage(able, "able"), 32), both).drop("ma", "mb")
    one, two = (met.select("g", F.col("root").alias(f"r{x}"), F.col("class").alias(f"c{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("name", "n", "rest", "last")]) for x in "ab")
    sized = (F.col("n_a") >= similarity * F.col("lb") - 1e-6) & (F.col("hb") >= similarity * F.col("n_a") - 1e-6)
    pairs = groups.join(one, ["g", "ra", "ca"]).where(sized).join(two, ["g", "rb", "cb"])
    pairs = pairs.where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-6)
    counts = pairs.groupBy("name_a", "name_b", "n_a", "n_b", "rest_a", "rest_b", "last_a", "last_b").count()
    # what is common beyond the prefix that ends first lies in the rest of its set
    most = F.col("count") + F.when(F.col("last_a") <= F.col("last_b"), F.col("rest_a")).otherwise(F.col("rest_b"))
    enough = most >= similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - 1e-6
    return counts.where(enough).select(F.least("name_a", "name_b").alias("u"), F.greatest("name_a", "name_b").alias("v"))


def similar_links(docs: DataFrame, speakers: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The edges of ``pairs(u, v)``, staged and distinct, whose speakers' shingle sets have at least the wanted Jaccard similarity."""
    wanted = pairs.select(F.col("u").alias("name")).unionByName(pairs.select(F.col("v").alias("name"))).distinct()
    ids = speakers.join(wanted, "name", "left_semi").select(F.col("doc_id").alias("__id"), F.col("k").alias("__k"), "name")
    ids = sent_if_small(stage(ids, "asked"), 32)
    texts = _keyed(docs)
    texts = texts.join(ids, _same_row(texts, ids)).select("name", "text")
    sets = stage(texts.mapInPandas(functools.partial(_sets, width=width), "name long, shingles array<long>").dropDuplicates(["name"]), "sets")
    # a hub of a large group stands in many pairs, on either side
    often = [stage(pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n")), "often") for side in ("u", "v")]
    both = spread_join(pairs, sets.select(F.col("name").alias("u"), F.col("shingles").alias("a")), "u", counts=often[0], least=HUB)
    both = spread_join(both, sets.select(F.col("name").alias("v"), F.col("shingles").alias("b")), "v", counts=often[1], least=HUB)
    common = F.size(F.array_intersect("a", "b"))
    # texts without words have empty sets and are alike
    return both.where(common >= similarity * (F.size("a") + F.size("b") - common)).select("u", "v")


def one_of_each(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without near copies; all columns stay."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    with passing(spark) as keep:
        rows = _keyed(docs).mapInPandas(functools.partial(_survey, width=width), "doc_id long, k long, print long, name long, given array<long>")
        survey = stage(rows, "survey")
        row = survey.select("doc_id", "k")
        roots, first = _groups(docs, survey, width, similarity, radius)
        best = first.join(roots, F.col("name") == F.col("u"), "left").groupBy(F.coalesce("root", "name").alias("root")).agg(F.min("best").alias("best"))
        stay = best.select(F.col("best.doc_id").alias("__id"), F.col("best.k").alias("__k"))
        # the rows that go are fewer than those that stay
        gone = row.distinct().select(F.col("doc_id").alias("i"), F.col("k").alias("j"))
        gone = gone.join(stay, F.col("i").eqNullSafe(F.col("__id")) & (F.col("j") == F.col("__k")), "left_anti")
        gone = keep(gone.select(F.col("i").alias("__id"), F.col("j").alias("__k")), "gone")
        again = not row.groupBy("doc_id", "k").count().where("count > 1").isEmpty()
    gone = sent_if_small(gone, 32)
    kept = docs.join(gone, _same_row(docs, gone), "left_anti")
    if not again:
        return kept
    (k,) = fresh(docs.columns, "k")
    return kept.withColumn(k, F.xxhash64("text")).dropDuplicates(["doc_id", k]).drop(k)


def _groups(docs: DataFrame, survey: DataFrame, width: int, similarity: float, radius: int) -> tuple[DataFrame, DataFrame]:
    """``(u, root)`` of the sets that are similar to another, and ``(name, best, print)`` of all sets."""
    spark = docs.sparkSession
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k")
    first = survey.groupBy("name").agg(F.min(order).alias("best"), F.min("print").alias("print"))
    first = stage(first.select("name", "best", "print"), "names")
    # one row speaks for each set
    speakers = stage(_speakers(survey, first), "speakers")
    with passing(spark) as keep:
        pairs = keep(print_links(first, radius).unionByName(candidates(speakers)).distinct(), "candidates")
    with passing(spark) as keep:
        edges = similar_links(docs, speakers, pairs, width, similarity)
        roots = keep(connected_components(edges, "similar"), "roots")
    with passing(spark) as keep:
        pairs = keep(missing_candidates(docs, survey, speakers, roots, width, similarity), "candidates")
    with passing(spark) as keep:
        more = stage(similar_links(docs, speakers, pairs, width, similarity), "missing")
        if not more.isEmpty():
            roots = keep(connected_components(roots.select("u", F.col("root").alias("v")).unionByName(more), "similar"), "roots")
    return roots, first


def _speakers(survey: DataFrame, first: DataFrame) -> DataFrame:
    """``(name, doc_id, k, given)`` of the row that speaks for each set."""
    best = first.select(F.col("name").alias("__n"), F.col("best.doc_id").alias("__id"), F.col("best.k").alias("__k"))
    same = (survey["name"] == best["__n"]) & survey["doc_id"].eqNullSafe(best["__id"]) & (survey["k"] == best["__k"])
    return survey.join(best, same).select("name", "doc_id", "k", "given").dropDuplicates(["name"])

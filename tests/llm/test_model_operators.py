"""SimHash groups, neighbours, byte models, language and quality classifiers, and the pipeline."""

import functools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from fixtures import docs, empty, prose, texts
from pyspark.sql import functions as F

import corpus_pipeline
from keystrata.llm import classifier, common, language, neighbours, scoring, similar, simhash
from keystrata.llm.common import connected_components, crc_mod, crc_mod_py

# SimHash


def plain_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=3):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                root[find(a)] = find(b)
    return [find(i) for i in range(len(prints))]


def test_simhash(spark):
    got = simhash.near_duplicates(docs(spark)).toPandas()
    rows = [r for r in texts()]
    prints = [plain_fingerprint(t, 3) for _, t in rows]
    group = plain_groups(prints)
    want = []
    for (i, _), p, g in zip(rows, prints, group):
        least = min((j for (j, _), h in zip(rows, group) if h == g and j is not None), default=None)
        want.append((i, f"{p:016x}", least))
    none = lambda x: None if pd.isna(x) else int(x)
    assert sorted(((none(a), b, none(c)) for a, b, c in got.itertuples(index=False)), key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_masks_cover_every_difference():
    rng = np.random.default_rng(2)
    masks = [m & (1 << 64) - 1 for m in simhash.masks()]
    assert len(masks) == 15
    for _ in range(3000):
        difference = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))
        assert any(difference & m == 0 for m in masks)


@pytest.mark.parametrize("small", [0, 2, 32])
def test_links_of_dense_groups(spark, small):
    rng = np.random.default_rng(3)
    prints = set()
    for _ in range(6):
        now = int(rng.integers(0, 1 << 63))
        for _ in range(25):  # chains and clouds of near values
            prints.add(now)
            flips = sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))
            prints.add(now ^ flips)
            now = now ^ flips if rng.random() < 0.5 else now
    prints = sorted(prints)
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    roots = {r["u"]: r["root"] for r in connected_components(simhash.links(df, small=small)).collect()}
    mine = [roots.get(p, p) for p in signed]
    theirs = plain_groups(prints)
    assert len(set(zip(mine, theirs))) == len(set(mine)) == len(set(theirs))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["u"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each(spark):
    source = docs(spark)
    out = similar.one_of_each(source)
    assert out.schema.simpleString() == source.schema.simpleString()
    ids = [r["doc_id"] for r in out.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and ids.count(9) == 1 and ids.count(None) == 1
    assert 4 in ids and 5 not in ids and 6 not in ids  # texts without words are one group
    assert {7, 8, 10, 11, 12, 15, 16} <= set(ids)


def test_one_of_each_keeps_columns_that_clash(spark):
    rows = [(1, prose(30, 1)), (1, prose(30, 1)), (2, prose(30, 2)), (None, prose(30, 3))]
    source = docs(spark, rows)
    out = similar.one_of_each(source)
    assert out.columns == source.columns and out.count() == 3
    assert {r["__k"] for r in out.select("__k").collect()} == {"k"}


def test_hot_keys_are_dealt(spark, monkeypatch):
    # every key with more than a few rows is hot: results stay the same
    monkeypatch.setattr(common.spread_join, "__defaults__", ("inner", None, 1000, 2))
    monkeypatch.setattr(similar, "HUB", 2)
    test_simhash(spark)
    base = prose(300, 1).split()
    rows = [(n, " ".join(base[:n] + ["x"] + base[n:])) for n in range(60)] + [(100 + n, prose(200, 40 + n)) for n in range(10)]
    assert {r["doc_id"] for r in similar.one_of_each(docs(spark, rows)).collect()} == {0, *range(100, 110)}
    edges = [(0, i) for i in range(1, 50)] + [(60, 61)]
    got = {r["u"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(50)} | {60: 60, 61: 60}


def test_one_of_each_against_all_pairs(spark):
    rng = random.Random(9)
    rows = []
    for base in range(25):
        words = prose(rng.choice([6, 20, 60, 200, 900]), base).split()
        for _ in range(rng.choice([1, 2, 6])):
            copy = [w if rng.random() > rng.choice([0, 0.005, 0.02, 0.2]) else "changed" for w in words]
            rows.append((len(rows), " ".join(copy)))
    shingles = []
    for _, t in rows:
        w = t.lower().split()
        shingles.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    want = {find(i) for i in range(len(rows))}
    got = {r["doc_id"] for r in similar.one_of_each(docs(spark, rows)).collect()}
    assert got == want
    assert similar.one_of_each(empty(spark)).count() == 0


def test_one_of_each_with_widely_shared_passages(spark):
    # most of a text are passages that many others have, so that the hubs of its shingles are other texts
    rng = random.Random(4)
    passages = [prose(60, 500 + n) for n in range(40)]
    rows = []
    for n in range(220):
        words = " ".join([*rng.sample(passages, 6), prose(60, 1000 + n)]).split()
        rows.append((len(rows), " ".join(words)))
        if n % 4 == 0:
            words[rng.randrange(len(words))] = "changed"
            rows.append((len(rows), " ".join(words)))
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    gone = {b for a in range(len(rows)) for b in range(a + 1, len(rows)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(gone) >= 55
    got = {r["doc_id"] for r in similar.one_of_each(docs(spark, rows)).collect()}
    assert got == set(range(len(rows))) - gone


def test_prefixes_meet():
    rng = np.random.default_rng(6)
    for n in (1, 2, 4, 5, 9, 10, 41, 300):
        for similarity in (0.5, 0.8, 1.0):
            whole = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            part = np.sort(rng.permutation(whole)[: math.ceil(similarity * n - 1e-6)])
            frequent = np.sort(rng.permutation(whole)[: n // 2])
            levels = rng.integers(1, 128, len(frequent)).astype(np.uint8)
            first, other = (similar.prefix_of(x, frequent, levels, similarity) for x in (whole, part))
            assert len(first) and np.intersect1d(first, other).size


def test_one_fingerprint_of_different_texts(spark):
    # one shingle makes up over half of each text and so sets all bits of its fingerprint
    bars = "| " * 200
    a, b = bars + prose(90, 1), bars + prose(90, 2)
    assert simhash.fingerprint_of(a.encode(), 5) == simhash.fingerprint_of(b.encode(), 5)
    rows = [(1, a), (2, b), (3, bars + prose(90, 3)), (4, b + " more"), (5, bars + "| " + prose(90, 3))]
    assert {r["doc_id"] for r in similar.one_of_each(docs(spark, rows)).collect()} == {1, 2, 3}


# neighbours


def plain_neighbours(rows, queries, k):
    out = {}
    for q in queries:
        v = rows[q]
        best = sorted(((-float(np.dot(v, w)), i) for i, w in rows.items() if i != q))[:k]
        out[q] = [i for _, i in best]
    return out


def test_neighbours_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = {i: (centres[rng.integers(12)] + rng.normal(size=16) * 0.6).astype(np.float32).astype(float) * rng.uniform(0.5, 2) for i in range(6000)}
    for i in range(3000, 4500):
        rows[i] = rows[17]  # a quarter is one vector
    df = spark.createDataFrame([(i, v.tolist(), i) for i, v in rows.items()], "vec_id long, embedding array<double>, score long").repartition(4)
    got = neighbours.search(df, F.col("vec_id") % 100 == 0, k=20).toPandas()
    want = plain_neighbours(rows, [i for i in rows if i % 100 == 0], 20)
    assert (got.groupby("query_id").size() == 20).all() and set(got["query_id"]) == set(want)
    hit = sum(len(set(g["vec_id"]) & set(want[q])) for q, g in got.groupby("query_id"))
    assert hit >= 0.95 * 20 * len(want)
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and q not in set(g["vec_id"])
        assert sorted(zip(-g["score"], g["vec_id"])) == list(zip(-g["score"], g["vec_id"]))
        assert np.allclose(g["score"], [np.dot(rows[q], rows[i]) for i in g["vec_id"]], rtol=1e-12)


def test_neighbours_with_many_buckets(spark, monkeypatch):
    # small buckets: lists have several, and every ratio reads all lists
    monkeypatch.setattr(neighbours, "BUCKET", 40)
    rng = np.random.default_rng(7)
    rows = {i: rng.normal(size=8).astype(np.float32).astype(float) for i in range(1500)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, embedding array<double>").repartition(4)
    got = neighbours.search(df, F.col("vec_id") % 50 == 0, k=7, ratio=100.0).toPandas().sort_values(["query_id", "rank"])
    want = plain_neighbours(rows, [i for i in rows if i % 50 == 0], 7)
    assert {q: g["vec_id"].tolist() for q, g in got.groupby("query_id")} == want


def test_neighbours_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [nan, 1.0]), (80, [1.0, None]), (1, [2.0, 1.0]), (2, [2.0, -1.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [inf, 0.0]), (5, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in neighbours.search(df, F.col("vec_id") % 20 == 0, k=3).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 3, 1.0)]
    assert len(neighbours.search(df, F.col("vec_id") % 20 == 0, k=20).collect()) == 3
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("ratio", [1.0, 1.1, 1.3])
def test_walk_finds_the_nearest_centres(ratio):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(700, 17)).astype(np.float32)
    x = rng.normal(size=(40, 17)).astype(np.float32)
    got = neighbours.walk(x, centres, neighbours.neighbour_graph(centres), ratio)
    d = neighbours.distances(x, centres)
    want = d <= ratio * d.min(axis=1, keepdims=True) + 1e-6
    assert (got & want).sum() > 0.95 * want.sum() and got.any(axis=1).all()


def test_buckets():
    first, parts = neighbours._buckets([5000, 3000, 8192, 20000, 0, 1])
    assert (first, parts) == ([0, 0, 1, 2, 5, 5], [1, 1, 1, 3, 1, 1])


# byte model


def test_kt_and_gamma():
    x = np.array([0.5, 1.0, 1.5, 3.0, 7.9, 8.0, 123.4, 1e6])
    assert np.allclose(scoring.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    sequential = 0.0
    a = b = 0
    for bit in (0, 1, 1, 0, 1):
        sequential += math.log(((b if bit else a) + 0.5) / (a + b + 1))
        a, b = a + (not bit), b + bit
    assert np.isclose(scoring.log_block(np.array([a]), np.array([b]))[0], sequential)


def plain_tree(train, depth):
    """The model by its definition: nodes in dictionaries, mixed by recursion. ``train`` gives each text its number.
    Returns a function that scores a text."""
    counts = Counter()
    symbols = lambda t: bytes(depth) + t + b"\xff"
    for t, n in train.items():
        s = symbols(t)
        for i in range(depth, len(s)):
            for j in range(8):
                for d in range(depth + 1):
                    counts[(s[i - d : i], j, s[i] >> (8 - j), s[i] >> (7 - j) & 1)] += n
    kids = {}
    for context, j, bits, _ in counts:
        kids.setdefault((context, j, bits), set())
        if context:
            kids.setdefault((context[1:], j, bits), set()).add(context)
    pe = functools.cache(lambda n: float(scoring.log_block(np.array([counts[(*n, 0)]]), np.array([counts[(*n, 1)]]))[0]))

    @functools.cache
    def parts(n):
        """log of the node's own half of the mixture, and of its children's."""
        return math.log(0.5) + pe(n), math.log(0.5) + sum(weighted((c, n[1], n[2])) for c in kids[n])

    def weighted(n):
        return pe(n) if len(n[0]) == depth else float(np.logaddexp(*parts(n)))

    def predict(s, i, j, d, bit):
        n = (s[i - d : i], j, s[i] >> (8 - j))
        if n not in kids:
            return None
        own = (counts[(*n, bit)] + 0.5) / (counts[(*n, 0)] + counts[(*n, 1)] + 1)
        below = predict(s, i, j, d + 1, bit) if d < depth else None
        if below is None:
            return own
        a, b = parts(n)
        return math.exp(a - weighted(n)) * own + math.exp(b - weighted(n)) * below

    def score(text):
        s, total = symbols(text), 0.0
        for i in range(depth, len(s)):
            for j in range(8):
                p = predict(s, i, j, 0, s[i] >> (7 - j) & 1)
                total += math.log10(0.5 if p is None else p)
        return total

    return score


@pytest.mark.parametrize("depth, block, head, head_codes", [(scoring.DEPTH, scoring.BLOCK, 1000, 1000), (scoring.DEPTH, 40, 2, 3), (2, 40, 2, 1_000_000), (3, 1_000_000, 1000, 0)])
def test_scores(spark, depth, block, head, head_codes):
    rows = [(i, t if t is None else t[:400]) for i, t in texts()]
    got = scoring.judge(docs(spark, rows), depth=depth, block=block, head=head, head_codes=head_codes).toPandas()
    train = Counter(scoring.prepared(t) for i, t in rows if crc_mod_py(i, 5) != 1)
    counts = Counter()
    for t, times in train.items():
        for w in [*t.split(), None]:
            counts[w] += times
    n, distinct = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    plain = plain_tree(train, depth)
    for i, t in dict(rows).items():
        raw = scoring.prepared(t)
        words = [*raw.split(), None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (distinct + 1))) for w in words)
        want = plain(raw)
        same = got[got["doc_id"].isna()] if i is None else got[got["doc_id"] == i]
        assert len(same) and np.isclose(same["base_score"], base).all() and np.isclose(same["score"], want, rtol=1e-9).all(), i
        assert (same["n_tokens"] == len(words)).all() and (same["n_known"] == sum(counts[w] > 0 for w in words)).all()
        assert np.isclose(same["bits_per_byte"], -want / math.log10(2) / (len(raw) + 1)).all()
        assert (same["train_tokens"] == n).all() and (same["held_out"] == (crc_mod_py(i, 5) == 1)).all()


def test_scores_are_finite_at_any_counts():
    depth = 3
    train = Counter({b"aaaa": 10**9, b"tps: ": 20, b"tps:x": 10**12, b"zq": 1})
    asked = [b"tps: ", b"tps:!", b"aaaab", b"zz", b"", b"\x00\x7f"]
    counts = Counter()
    for t, n in train.items():
        for c in scoring.sequences([t], depth)[0].tolist():
            counts[c] += n
    for t in asked:
        for c in scoring.sequences([t], depth)[0].tolist():
            counts[c] += 0
    frame = pd.DataFrame({"code": np.array(list(counts), dtype=np.uint64).view(np.int64), "n": list(counts.values())})
    upper = scoring.top_levels(scoring._summaries(None, frame, depth, 3), 3)
    value = dict(zip(counts, scoring._values(frame, upper, depth, 3)))
    plain = plain_tree(train, depth)
    for t in asked:
        got = sum(value[c] for c in scoring.sequences([t], depth)[0].tolist())
        want = plain(t)
        assert math.isfinite(got) and got < 0 and np.isclose(got, want, rtol=1e-9), t
    assert sum(value[c] for c in scoring.sequences([b"tps:!"], depth)[0].tolist()) < -8


def test_table_of_values():
    rng = np.random.default_rng(4)
    codes = np.unique(rng.integers(0, 1 << 48, 5000).astype(np.uint64))
    table = scoring.Table(codes, np.arange(1.0, len(codes) + 1))
    values, missing = table.get(np.concatenate([codes, codes + np.uint64(1)]))
    assert values[: len(codes)].tolist() == list(range(1, len(codes) + 1))
    assert set(missing.tolist()) == {len(codes) + i for i, c in enumerate(codes.tolist()) if c + 1 not in set(codes.tolist())}
    assert scoring.Table(codes[:0], np.empty(0)).get(codes)[1].tolist() == list(range(len(codes)))


def test_scores_of_nothing(spark):
    assert scoring.judge(empty(spark)).count() == 0


def test_checksums(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 12345678901, None)], "doc_id long")
    for r in df.select("doc_id", crc_mod(F.col("doc_id"), 5).alias("m")).collect():
        assert r["m"] == crc_mod_py(r["doc_id"], 5) == zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5


# language


def test_language(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language.identify(source).join(source.select("doc_id", "lang", "text"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(got) == source.count() and (held["lang"] == held["lang_pred"]).mean() > 0.9
    assert got["score"].between(0, 1).all()


def plain_language(rows, room):
    """Every text compressed with every dictionary, which is built anew from the rows."""
    import zstandard

    texts_of = {}
    for i, t, lang in rows:
        if crc_mod_py(i, 4) != 2 and t is not None and lang is not None:
            texts_of.setdefault(lang, []).append(t)
    content = {}
    for lang, own in texts_of.items():
        pieces = sorted((at // language.PIECE, n, t[at : at + language.PIECE]) for n, t in enumerate(own) for at in range(0, max(1, len(t)), language.PIECE))
        content[lang] = b" ".join(language.prepared(p) for _, _, p in pieces)[:room]
    params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_GREEDY, window_log=18, hash_log=17, chain_log=17, search_log=3, min_match=4, target_length=16, write_content_size=0, write_checksum=0, write_dict_id=0)
    out = {}
    for i, t, _ in rows:
        if t is None or not any(map(str.isalpha, t)):
            out[i] = "und", None
            continue
        size = {lang: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params).compress(language.prepared(t))) for lang, c in content.items()}
        best = min(size.values())
        out[i] = {lang for lang, n in size.items() if n == best}, size
    return out


def test_language_against_plain_compression(spark):
    rng = random.Random(3)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(300)] for lang, letters in (("aa", "abcdefgh"), ("bb", "efghijkl"), ("cc", "éöïabmno"), ("dd", "日本語漢字仮名"))}
    rows = []
    for n in range(240):
        lang = rng.choice(list(words))
        size = rng.choice([1, 3, 30, 200, 2500])
        text = " ".join(rng.choice(words[lang]).upper() if rng.random() < 0.1 else rng.choice(words[lang]) for _ in range(size))
        rows.append((n, rng.choice([text, text, text, text + "!! 123"]), lang))
    rows += [(500, None, "aa"), (501, "1 2 3", "bb"), (502, "", "cc"), (503, "abc", None)]
    # dictionaries take pieces in the order of hashed ids
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    order = [r["doc_id"] for r in frame.orderBy(F.xxhash64("doc_id")).collect()]
    rows.sort(key=lambda r: order.index(r[0]))
    want = plain_language(rows, language.room(4))
    got = {r["doc_id"]: r for r in language.identify(frame).collect()}
    assert len(got) == len(rows)
    for i, (langs, _) in want.items():
        assert got[i]["lang_pred"] in langs if langs != "und" else got[i]["lang_pred"] == "und", i
        assert 0 <= got[i]["score"] <= 1 and got[i]["held_out"] == (crc_mod_py(i, 4) == 2)


def test_every_language_is_learned(spark):
    long = "zorvik blenta quosh marn telvi dusk " * 20_000
    rows = [(n, long, "zz") for n in range(3)] + [(n, prose(80, n), "en") for n in range(6, 20)] + [(100 + n, f"only{n} word{n}s", f"l{n}") for n in range(300)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    content = dict(zip(model.langs, model.content))
    assert len(content) == 302 and all(content.values()) and sum(map(len, content.values())) <= language.ALL
    assert len(content["zz"]) == language.room(302) < language.DICTIONARY
    assert language.classify("telvi dusk zorvik blenta quosh marn", model.langs, tuple(model.content))[0] == "zz"


def test_language_cases(spark):
    rows = [(1, "the cat sat on the mat and the dog ran"), (2, "1234 !!"), (3, ""), (4, None), (5, "le chat est dans la maison"), (5, "le chat est dans la maison")]
    model = language.Model({"en": (5, ["the cat and the dog were on the mat in the sun"] * 3), "fr": (3, ["le chat et le chien sont dans la maison"] * 3)})
    got = {r["doc_id"]: r for r in language.predict(docs(spark, rows), model, "doc_id").collect()}
    assert [got[i]["lang_pred"] for i in range(1, 6)] == ["en", "und", "und", "und", "fr"]
    assert got[4]["score"] == 0 and got[1]["score"] > 0.5
    untrained = language.identify(docs(spark, rows).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in untrained.collect()} == {"und"}
    assert language.identify(empty(spark)).count() == 0


# quality classifier


@pytest.fixture(scope="session")
def larger():
    return "/root/testdata/sf0.01"


def test_classifier(spark, larger):
    source, labels = spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/labels.parquet")
    got = classifier.judge(source, labels).join(labels, "doc_id").toPandas()
    assert (got["predicted"] == got["quality"])[got["held_out"]].mean() > 0.9
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()


def plain_classifier(rows, labels, asked):
    """The same model from feature sets in dictionaries: ratios, the dual problem solved one variable at a time, the curve."""
    drawn = sorted(((xxhash.xxh64_intdigest(str(i).encode()), i) for i in labels))
    feats = {i: set(classifier.features(rows[i]).tolist()) for i in rows}
    ids = [i for _, i in drawn]
    rest = [i for n, i in enumerate(ids) if n % 5 == 0] if len(ids) >= 50 else []
    inside = [i for i in ids if i not in rest]
    total = {y: classifier.COLUMNS * classifier.SMOOTH + sum(len(feats[i]) for i in inside if labels[i] == y) for y in (0, 1)}
    counts = {y: Counter(c for i in inside if labels[i] == y for c in feats[i]) for y in (0, 1)}
    ratio = lambda c: math.log((counts[1][c] + classifier.SMOOTH) / total[1]) - math.log((counts[0][c] + classifier.SMOOTH) / total[0])
    values = {i: {c: ratio(c) for c in feats[i]} for i in rows}
    for v in values.values():
        norm = math.sqrt(sum(x * x for x in v.values()))
        for c in v:
            v[c] /= max(norm, 1e-12)
    w, bias, alpha = Counter(), 0.0, dict.fromkeys(inside, 0.0)
    sign = {i: 1.0 if labels[i] else -1.0 for i in inside}
    dot = lambda i: sum(w[c] * x for c, x in values[i].items()) + bias
    for _ in range(120):
        for i in inside:
            new = min(max(alpha[i] - (sign[i] * dot(i) - 1) / (1 + sum(x * x for x in values[i].values())), 0.0), classifier.BOUND)
            step, alpha[i] = (new - alpha[i]) * sign[i], new
            bias += step
            for c, x in values[i].items():
                w[c] += step * x
    fitted = rest or inside
    y = np.array([labels[i] for i in fitted], dtype=float)
    share = sum(labels.values()) / len(labels)
    weights = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    slope, offset = classifier.logistic(np.array([dot(i) for i in fitted]), y, weights)
    return {i: 1 / (1 + math.exp(-(slope * dot(i) + offset))) for i in asked}


def test_classifier_against_plain_fit(spark, monkeypatch):
    # many passes bring both to the optimum of one convex problem
    monkeypatch.setattr(classifier.dual_descent, "__defaults__", (classifier.BOUND, 120, 3))
    rng = random.Random(5)
    rows, labels = {}, {}
    for i in range(160):
        good = rng.random() < 0.6
        words = [rng.choice(["alpha", "beta", "gamma", "delta"] if good else ["CLICK!!", "free", "$$$", "win"]) if rng.random() < 0.4 else f"w{rng.randrange(80)}" for _ in range(rng.randrange(3, 60))]
        rows[i] = " ".join(words)
        if i % 4:
            labels[i] = int(good)
    rows[900], rows[901] = "", None
    table = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    marks = spark.createDataFrame([(i, y) for i, y in labels.items()], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in classifier.judge(table, marks).collect()}
    used = {i: y for i, y in labels.items() if crc_mod_py(i, 5) != 0}
    want = plain_classifier(rows, used, rows)
    assert len(got) == len(rows)
    for i, p in want.items():
        assert abs(got[i]["score"] - p) < 2e-3, (i, got[i]["score"], p)
        assert got[i]["held_out"] == (crc_mod_py(i, 5) == 0) and got[i]["predicted"] == int(got[i]["score"] >= 0.3)


def test_dual_descent_meets_its_conditions():
    rng = np.random.default_rng(7)
    rows = [np.unique(rng.integers(0, 40, 8)).astype(np.int32) for _ in range(80)]
    values = [np.ones(len(r)) / math.sqrt(len(r)) for r in rows]
    signs = np.where([5 in r or 6 in r for r in rows], 1.0, -1.0)
    w, bias = classifier.dual_descent(rows, values, signs, 40, passes=2000)
    margins = signs * np.array([w[r] @ v + bias for r, v in zip(rows, values)])
    primal = 0.5 * (w @ w + bias**2) + np.maximum(0, 1 - margins).sum()
    for _ in range(200):  # no near point is better
        dw, db = rng.normal(size=40) * 0.01, rng.normal() * 0.01
        m = signs * np.array([(w + dw)[r] @ v + bias + db for r, v in zip(rows, values)])
        assert 0.5 * ((w + dw) @ (w + dw) + (bias + db) ** 2) + np.maximum(0, 1 - m).sum() >= primal - 1e-3


def test_classifier_cases(spark):
    source = docs(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, None), (None, 0), (10, 1), (10, 0)], "doc_id long, quality int")
    got = classifier.judge(source, labels).collect()
    assert len(got) == len(texts()) and {r["predicted"] for r in got} == {1}  # one class only
    model = classifier.fit_rows([classifier.features(t) for t in ("good text here", "bad!! BAD!! BAD!!")] * 3, np.array([1, 0] * 3))
    assert model.score(classifier.features("good text")) > model.score(classifier.features("BAD!! BAD!!"))
    assert classifier.features(None).size == 0 and 0 < model.score(classifier.features("")) < 1
    assert classifier.judge(empty(spark), labels).count() == 0


# pipeline


def test_pipeline(spark, larger):
    sf_dir = larger
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = source
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, sf_dir)
        assert out.columns == source.columns, name
        assert not {r["doc_id"] for r in out.select("doc_id").collect()} - {r["doc_id"] for r in rows.select("doc_id").collect()}
        rows = corpus_pipeline.stage(out, "test")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {r["doc_id"] for r in rows.select("doc_id").collect()}
    quality = {r["doc_id"]: r["quality"] for r in good.collect()}
    assert sum(1 for i in kept if quality.get(i) == 0) <= 1
    pieces = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert set(pieces["doc_id"]) == kept
    assert pieces.groupby("doc_id")["length"].sum().tolist() == pieces.groupby("doc_id")["doc_tokens"].first().tolist()



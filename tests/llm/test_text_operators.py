"""Packing, byte-level BPE, quality rules, secrets and substring dedup against plain versions."""

import hashlib
import os
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from fixtures import docs, empty, multiset, texts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keystrata.llm import bpe, common, packing, quality_rules, queries, secrets, substrings
from keystrata.llm.common import fresh, spread_join


def sha(data):
    return hashlib.sha256(data).hexdigest()


# packing


@pytest.mark.parametrize("capacity, open_windows, fan_in", [(4096, 64, 32), (64, 4, 2), (37, 1, 2)])
def test_packing(spark, capacity, open_windows, fan_in):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")) for i, t in texts()]
    got = packing.pack(docs(spark), capacity=capacity, open_windows=open_windows, fan_in=fan_in).toPandas()
    want = sorted((i, start, zlib.crc32(x[start : start + capacity].tobytes()), len(x)) for i, x in ids if i is not None for start in range(0, len(x), capacity))
    rows = got[got["doc_id"].notna()]
    assert sorted(zip(rows["doc_id"], rows["start"], rows["ids_crc32"], rows["doc_tokens"])) == want
    assert got["length"].sum() == sum(len(x) for _, x in ids)
    for _, window in got.sort_values("offset").groupby("sequence_id"):
        assert (window["length"].cumsum() - window["length"]).tolist() == window["offset"].tolist()
        assert window["length"].sum() <= capacity
    assert packing.pack(empty(spark)).count() == 0


def test_packer_takes_the_best_fit():
    p = packing.Packer(10, 2)
    assert [p.place(n)[0] for n in (6, 7, 3, 4, 5, 5)] == [0, 1, 1, 0, 2, 2]
    p = packing.Packer(10, 2)
    p.place(6), p.place(7)
    assert p.place(9)[2] == 1  # the fullest makes room


def test_special_names_and_marks(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    cache = packing._Words(public_tokenizers.path("word_bpe_49k.json"))
    for text in ["a<|endoftext|>b", "A <|ENDOFTEXT|>", "Don't. it's!! x.'s", "Σας. ΑΣ. 12.5%, é. ﬁn… ½.", '"q" (x) [y]-z- --a', "é. É!", "İstanbul. K."]:
        mine = b"".join(map(cache.__getitem__, cache.split(text.encode())))
        assert np.frombuffer(mine, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


# byte-level BPE


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(spark, reference):
    got = bpe.round_trip(docs(spark))
    want = []
    for i, t in texts():
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert multiset(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe.round_trip(empty(spark)).count() == 0


def test_bpe_encode_and_decode(spark, reference):
    coded = bpe.encode(docs(spark).where("doc_id is not null"))
    for r in coded.collect():
        assert any(i == r["doc_id"] and reference.encode_ordinary(t or "") == r["ids"] for i, t in texts())
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(coded).collect()}
    assert all(back[i] == (t or "").encode() for i, t in texts() if i is not None)
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first()["bytes"] == b""


def test_bpe_long_words(reference):
    codec = bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rng, pick = np.random.default_rng(8), random.Random(8)
    words = [b"abcde" * 120, b" the", b"a" * 20_000, b"the" * 500, b"", b"x"]
    words += [bytes(rng.choice(list(alphabet), n).tolist()) for alphabet in (b"ab", b"aeinrst", bytes(range(97, 123)), bytes(range(128, 256))) for n in (60, 300, 1500)]
    runs = lambda: pick.choice([b"a" * pick.randrange(1, 90), b"ab" * pick.randrange(1, 60), b"the" * pick.randrange(1, 30), bytes(rng.choice(list(b"aeinrst"), 90).tolist())])
    words += [b"".join(runs() for _ in range(pick.randrange(2, 20))) for _ in range(30)]
    words += ["".join(chr(pick.randrange(*span)) for _ in range(30)).encode() for span in ((0x4E00, 0x9FA5), (0xE01, 0xE3B), (0x3041, 0x3096), (0x430, 0x44F)) for _ in range(50)]
    words += [b"".join(pick.choice(list(codec.ranks)) for _ in range(pick.randrange(2, 90))) for _ in range(100)]
    want = [[codec.ranks[w]] if w in codec.ranks else reference._encode_single_piece(w) if w else [] for w in words]
    assert codec.encode_words(words) == want
    assert codec.encode_words(words) == want  # with parts remembered
    assert codec.decode_words(want) == words
    codec.lookup({" the", "x" * 100})
    assert list(codec.words) == [" the"]


def test_bpe_parts_are_where_no_token_spans():
    codec = bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = np.random.default_rng(9)
    words = [bytes(rng.integers(97, 123, 40).astype(np.uint8)) for _ in range(200)]
    for word, parts in zip(words, codec.parts_of(words)):
        assert b"".join(parts) == word
        cuts = set(np.cumsum([len(p) for p in parts])[:-1].tolist())
        spans = [(i, j) for i in range(len(word)) for j in range(i + 2, min(len(word), i + 34) + 1) if word[i:j] in codec.ranks]
        assert not any(i < c < j for i, j in spans for c in cuts)


def test_bpe_is_fast_on_long_words():
    codec = bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    start = time.time()
    rng = np.random.default_rng(10)
    codec.encode_words([b"a" * 100_000, bytes(rng.integers(97, 123, 100_000).astype(np.uint8)), bytes(rng.choice(list(b"aeinrst"), 50_000).tolist())])
    assert time.time() - start < 60


# quality rules


def test_quality_rules_measures(spark):
    got = {}
    for r in quality_rules.judge(docs(spark)).collect():
        got.setdefault(r["doc_id"], r)
    for i, t in texts():
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(words[j : j + 3]) for j in range(len(words) - 2)]
        covered = {p for j, g in enumerate(grams) if grams.count(g) > 1 for p in (j, j + 1, j + 2)} if len(grams) < 5000 else None
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        row = got[i]
        assert row["n_words"] == len(words) and row["word_chars"] == sum(map(len, words))
        assert row["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t or "")) and row["n_dup_lines"] == len(lines) - len(set(lines))
        if covered is not None:
            assert row["n_repeat_words"] == len(covered)
            assert row["base_failed"] == (len(words) < 50 or 2 * len(covered) > len(words))
        assert not (row["base_failed"] and row["kept"])
    assert quality_rules.judge(empty(spark)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf_dir)
    assert multiset(got, *want.columns) == sorted(want.fetchall(), key=repr)
    assert [dict(got.dtypes)[c] for c in want.columns] == [{"BIGINT": "bigint", "VARCHAR": "string", "BOOLEAN": "boolean"}[str(t)] for t in want.types]


def test_quality_rules_run_no_python(spark):
    plan = quality_rules.judge(docs(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# secrets


def base_spans(text):
    rules = {
        "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A),
        "access": re.compile("AKIA[A-Z0-9]+"),
        "hex": re.compile("[0-9a-f]+"),
    }
    found = []
    for order, (kind, p) in enumerate(rules.items()):
        for m in p.finditer(text):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                found.append((m.start(), order, kind, m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


SECRETS = [
    (1, "token=abc token: \"abcdefgh\" é😀 Secret = x12345678 AKIA" + "A" * 20),
    (2, "secret=token: abcdefg"),
    (3, "a" * 30 + 'PASSWORD="hunter22"' + "f" * 25 + "AKIAAKIA" + "0" * 12),
    (4, None),
    (5, ""),
    (6, "AKIA" + "1" * 15 + " deadbeef" * 20 + " api_key:'k/+=._-1' apikey  =  zzzzzz passwd:short"),
    (7, "token=" + "9" * 3000),
    (7, "token=" + "9" * 3000),
    (8, "-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY----- ghp_" + "a1B2" * 9),
    (None, "passwd = 1234567"),
    (9, "ſecret=abcdefgh toKen=abcdefgh"),
]


def test_secrets(spark):
    got = secrets.digest(docs(spark, SECRETS)).collect()
    assert len(got) == len(SECRETS)
    for i, t in SECRETS:
        want = base_spans(t or "")
        rows = [r for r in got if r["doc_id"] == i]
        for r in rows:
            assert r["base_sha256"] == sha(",".join(want).encode()), (i, r["spans"])
            assert set(want) <= set(r["spans"].split(",")) | {""}
            assert r["n_assign"] + r["n_access"] + r["n_hex"] == len(want)
    kinds = next(r["spans"] for r in got if r["doc_id"] == 8)
    assert "pem:0:" in kinds and "github:" in kinds
    assert secrets.digest(empty(spark)).count() == 0


def test_ledger_scans_unseen_blobs_only(spark):
    first, second = docs(spark, SECRETS[:4]), docs(spark, SECRETS)
    _, ledger = secrets.scan(first)
    assert ledger.count() == 4
    fresh = secrets.update_ledger(second, ledger)
    known = {r["blob"] for r in ledger.collect()}
    assert fresh.count() == len({t or "" for _, t in SECRETS}) - 4
    assert not known & {r["blob"] for r in fresh.collect()}
    found, after = secrets.scan(second, ledger)
    assert multiset(found, "doc_id", "spans") == multiset(secrets.scan(second)[0], "doc_id", "spans")
    assert after.count() == len({t or "" for _, t in SECRETS})
    other = secrets.RULES[:1]
    assert secrets.update_ledger(first, ledger, other).count() == 4  # another rule version is unseen


def test_redaction(spark):
    source = docs(spark, SECRETS)
    out = secrets.redact(source)
    assert out.columns == source.columns and out.count() == len(SECRETS)
    texts_out = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts_out[4] is None and texts_out[5] == "" and texts_out[2] == SECRETS[1][1]
    assert texts_out[3] == '[SECRET][SECRET]"[SECRET][SECRET]'
    assert texts_out[7] == "[SECRET]" and "hunter22" not in texts_out[3]


def test_running_sums(spark):
    rng = np.random.default_rng(11)
    rows = [[int(x) for x in rng.integers(0, 50, n)] for n in (0, 1, 2, 3, 5, 8, 100, 257)]
    df = spark.createDataFrame([(r,) for r in rows], "a array<int>")
    got = df.select("a", secrets.running(F.col("a"), lambda x, y: x + y).alias("sums"), secrets.running(F.col("a"), lambda x, y: F.greatest(x, y)).alias("tops")).collect()
    for r in got:
        assert r["sums"] == np.cumsum(r["a"]).tolist() and r["tops"] == np.maximum.accumulate(r["a"] or [0])[: len(r["a"])].tolist()


def test_many_spans(spark):
    rng = random.Random(12)
    parts = [rng.choice([f"{n:032x}", "é" * rng.randrange(1, 40), "token=" + "f" * rng.randrange(6, 60), "😀 plain words", "\n", "AKIA" + "Z" * 20, "x" * 2000]) for n in range(1500)]
    rows = [(1, "".join(parts)), (2, " ".join(parts)), (3, "secret: " + "a" * 24 + "b" * 3000), (4, "f" * 24)]
    got = {r["doc_id"]: r for r in secrets.digest(docs(spark, rows)).collect()}
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs(spark, rows)).collect()}
    for i, t in rows:
        want = base_spans(t)
        assert got[i]["spans"].split(",") == want
        out, at = [], 0
        for _, a, b in (w.split(":") for w in want):
            if int(a) >= at:
                out += [t[at : int(a)], "[SECRET]"]
            at = max(at, int(b))
        assert clean[i] == "".join(out) + t[at:], i


def test_kept_ledger(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    first = secrets.digest(docs(spark, SECRETS[:4]), path=path)
    assert first.count() == 4 and spark.read.parquet(path).count() == 4
    both = secrets.digest(docs(spark, SECRETS), path=path)
    columns = ["doc_id", "base_sha256", "spans"]
    assert multiset(both, *columns) == multiset(secrets.digest(docs(spark, SECRETS)), *columns)
    assert spark.read.parquet(path).count() == len({t or "" for _, t in SECRETS})
    assert secrets.redact(docs(spark, SECRETS), path=path).count() == len(SECRETS)
    assert spark.read.parquet(path).count() == len({t or "" for _, t in SECRETS})
    assert secrets.redact(empty(spark)).count() == 0


def test_spread_join(spark):
    many = spark.createDataFrame([(7 if n % 3 else n, n) for n in range(600)] + [(None, 1)], "k long, n long").repartition(3)
    few = spark.createDataFrame([(k, f"v{k}") for k in range(0, 600, 2)] + [(7, "a"), (7, "b")], "k long, v string")
    for how in ("inner", "left"):
        want = multiset(many.join(few, "k", how), "k", "n", "v")
        assert multiset(spread_join(many, few, "k", how, part=10, least=5), "k", "n", "v") == want
        assert multiset(spread_join(many, few, "k", how), "k", "n", "v") == want
    assert fresh(["A", "b_"], "a", "b", "b") == ["a_", "b", "b__"]


def test_secrets_run_no_python(spark):
    plan = secrets.update_ledger(docs(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# substring dedup


def cut(rows, width):
    first = {}
    for i, t in rows:
        p = (t or "").encode().split()
        i = substrings.NO_ID if i is None else i
        for j in range(len(p) - width + 1):
            key = tuple(p[j : j + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        p, gone = (t or "").encode().split(), set()
        for j in range(len(p) - width + 1):
            if first[tuple(p[j : j + width])] < (substrings.NO_ID if i is None else i):
                gone.update(range(j, j + width))
        keep = [w for n, w in enumerate(p) if n not in gone]
        out.append((i, len(p), len(gone), sha(b" ".join(keep))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width, anchor", [(50, 16), (10, 4), (3, 1)])
def test_substrings(spark, width, anchor):
    rows = [*texts(), (9, "other text under an id that repeats " + texts()[13][1])]
    got = substrings.digest(docs(spark, rows), width, anchor)
    assert multiset(got, "doc_id", "n_words", "n_removed", "kept_sha256") == cut(rows, width)
    assert substrings.digest(empty(spark)).count() == 0


def test_substrings_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common.spread_join, "__defaults__", ("inner", None, 1000, 2))
    passage = " ".join(f"p{n}" for n in range(60))
    rows = [(n, f"{'a' * (n % 7)} own{n} {passage} end{n}") for n in range(80)] + texts()
    got = substrings.digest(docs(spark, rows))
    assert multiset(got, "doc_id", "n_words", "n_removed", "kept_sha256") == cut(rows, 50)
    assert substrings.remove_repeats(empty(spark)).count() == 0


def test_substrings_cut_text(spark):
    source = docs(spark)
    out = substrings.remove_repeats(source)
    assert out.schema.simpleString() == source.schema.simpleString() and out.count() == len(texts())
    want = {(i, s) for i, _, _, s in cut(texts(), 50)}
    for r in out.collect():
        assert (r["doc_id"], sha(b" ".join((r["text"] or "").encode().split()))) in want
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    assert kept[1] == texts()[0][1] and kept[16] == texts()[-1][1] and kept[5] is None and not kept[2].strip()
    assert substrings.cut_text(" a  b\nc d ", [(1, 3)]) == " a  d "
    starts = spark.createDataFrame([([0, 3, 5],), ([0, 4],), ([7],), ([],)], "s array<int>")
    assert [r[0] for r in starts.select(substrings.merged(F.col("s"), 3)).collect()] == [[[0, 8]], [[0, 3], [4, 7]], [[7, 10]], []]


def test_rolling_hashes():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    values[200:260] = values[20:80]
    h = substrings.rolling(values, 50, substrings.BASES[0])
    assert (h[200:211] == h[20:31]).all() and len(set(h.tolist())) == 251 - 11
    x = rng.integers(0, 1000, 100).astype(np.uint64)
    assert substrings.least_of_runs(x, 35).tolist() == [x[i : i + 35].min() for i in range(66)]
    assert pd.Series(substrings.rolling(values[:3], 5, 3)).empty


def test_passing_deletes_what_it_staged(spark):
    held = {}
    with common.passing(spark) as keep:
        held["gone"] = common.stage(spark.range(3), "gone").inputFiles()
        with common.passing(spark) as inner:
            held["inner"] = common.stage(spark.range(4), "inner").inputFiles()
            held["outer"] = inner(spark.range(5), "outer")
            kept = keep(spark.range(6), "kept")
        assert not any(os.path.exists(f.removeprefix("file://")) for f in held["inner"])
        assert held["outer"].count() == 5
        files = held["outer"].inputFiles()
    with pytest.raises(ZeroDivisionError), common.passing(spark):
        held["failed"] = common.stage(spark.range(2), "failed").inputFiles()
        raise ZeroDivisionError
    for f in held["gone"] + files + held["failed"]:
        assert not os.path.exists(f.removeprefix("file://"))
    assert sorted(r.id for r in kept.collect()) == list(range(6))

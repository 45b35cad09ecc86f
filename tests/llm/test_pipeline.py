"""The pipeline's rows against plain versions of its stages, one after the other."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures import docs, empty, prose, texts
from test_text_operators import SECRETS, base_spans
from tokenizers import Tokenizer

import corpus_pipeline
from keystrata.llm import classifier


def junk(seed):
    return " ".join(w.upper() + "!!" for w in prose(80, seed).split())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(i, t) for i, t in texts() if i != 9] + [(100 + n, prose(90, 50 + n)) for n in range(40)] + [(200 + n, junk(n)) for n in range(30)]
    rows += [(300 + i, t) for i, t in SECRETS if i not in (None, 7, 8)] + [(400, prose(60, 2))]
    path = tmp_path_factory.mktemp("tables")
    docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"file://{path}/documents.parquet")
    marks = [(100 + n, 1, 0) for n in range(40)] + [(200 + n, 0, 0) for n in range(0, 30, 2)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}", rows


def similar(a, b):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    a, b = shingles(a), shingles(b)
    return a == b or len(a & b) >= 0.8 * len(a | b)


def one_of_each(rows):
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    group = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if group[x] != group[y] and similar(rows[x][1], rows[y][1]):
                low, high = sorted((group[x], group[y]))
                group = [low if g == high else g for g in group]
    return [r for i, r in enumerate(rows) if group[i] == i]


def without_repeats(rows, width=50):
    first = {}
    order = lambda i: 1 << 62 if i is None else i
    for i, t in rows:
        w = (t or "").encode().split()
        for j in range(len(w) - width + 1):
            key = tuple(w[j : j + width])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for i, t in rows:
        parts = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t or "")
        head = (t or "")[: len(t or "") - len("".join(parts))]
        w, gone = [p.rstrip(" \t\n\x0b\x0c\r").encode() for p in parts], set()
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < order(i):
                gone.update(range(j, j + width))
        out.append((i, None if t is None else head + "".join(p for n, p in enumerate(parts) if n not in gone)))
    return out


def redacted(text):
    extra = {"pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "github": r"\bgh[pousr]_"}
    assert not any(re.search(p, text) for p in extra.values())
    out, at = "", 0
    for span in base_spans(text):
        _, a, b = span.split(":")
        if int(a) >= at:
            out += text[at : int(a)] + "[SECRET]"
        at = max(at, int(b))
    return out + text[at:]


def test_stages_equal_plain_versions(spark, folder):
    path, rows = folder
    source = spark.read.parquet(f"{path}/documents.parquet")
    model = classifier.fit_quality(source, spark.read.parquet(f"{path}/labels.parquet"))
    good = [r for r in rows if model.score(classifier.features(r[1])) >= classifier.THRESHOLD]
    assert all(r in good for r in rows if r[0] is not None and 100 <= r[0] < 140)
    assert not any(r[0] is not None and 200 <= r[0] < 230 for r in good)
    kept = without_repeats(one_of_each(good))
    clean = [(i, None if t is None else redacted(t)) for i, t in kept]

    frame = source
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.stage(stage(spark, frame, path), "test")
        assert frame.columns == source.columns, name
    assert sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=repr) == sorted(clean, key=repr)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in frame.collect())

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in clean:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want += [(i, s, zlib.crc32(ids[s : s + 4096].tobytes()), len(ids)) for s in range(0, len(ids), 4096)]
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted(((r["doc_id"], r["start"], r["ids_crc32"], r["doc_tokens"]) for r in got), key=repr) == sorted(want, key=repr)


def test_empty_tables(spark, tmp_path):
    path = f"file://{tmp_path}"
    empty(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0

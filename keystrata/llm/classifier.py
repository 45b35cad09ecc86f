"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of n-grams: words, pairs of words, and runs of up to three word shapes (letter case,
marks, digits), hashed to a fixed number of columns; a pair of equal words is one feature for all words. Each
indicator is scaled by its log-count ratio between the classes, texts are scaled to unit length, and a linear
hinge-loss model is fitted by dual coordinate descent. A logistic curve on texts left out of the fit gives the score.

The model is fitted on at most ``per_class`` labelled texts of each class, drawn by hashed id; scoring reads every
text whole.

Cases: a null text counts as empty; an empty text has the score of the bias; a text without a label is only scored;
several labels of one id count as the largest; with one class only, every score is that class; repeated rows score
alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import crc_mod, ship, stage

#: Feature columns, labelled texts of each class, smoothing of counts, bound of the dual variables, passes.
COLUMNS, PER_CLASS, SMOOTH, BOUND, PASSES = 1 << 18, 4000, 1.0, 1.0, 12
#: Share of the drawn texts that fits the logistic curve.
CALIBRATE = 0.2
#: Words that a worker remembers.
REMEMBERED = 200_000
THRESHOLD = 0.3


class _Words(dict):
    """16 bytes for a word: a hash of its lower-case form, and one of its shape."""

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        out = xxhash.xxh3_64_digest(text.lower().encode("utf-8", "replace")) + xxhash.xxh3_64_digest(shape(text))
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = out
        return out


def shape(word: str) -> bytes:
    """Case of the letters, whether there are digits, and the marks at both ends."""
    letters = word.strip("".join({c for c in word if not c.isalnum()}))
    head, _, tail = word.partition(letters) if letters else ("", "", word)
    core = "".join(c for c in letters if c.isalpha())
    case = "-" if not core else "U" if core.isupper() and len(core) > 1 else "l" if core.islower() else "C" if core[1:].islower() or len(core) == 1 else "m"
    digits = "9" if any(map(str.isdigit, letters)) else ""
    return f"{head[:3]} {case}{digits} {tail[:3]}".encode("utf-8", "replace")


_words = _Words()
_SAME = np.uint64(0xD6E8FEB86659FD93)
_PAIR, _S2, _S3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def features(text: str | None) -> np.ndarray:
    """The columns whose indicator is set, in order."""
    parts = b"" if text is None else text.encode("utf-8", "surrogatepass")
    parts = parts.split()
    if not parts:
        return np.empty(0, dtype=np.int32)
    x = np.frombuffer(b"".join(map(_words.__getitem__, parts)), dtype=">u8").reshape(-1, 2).astype(np.uint64)
    w, s = x[:, 0], x[:, 1]
    with np.errstate(over="ignore"):
        same = w[1:] == w[:-1]
        pairs = np.where(same, _SAME, w[:-1] * _PAIR + w[1:])
        two = s[:-1] * _S2 + s[1:]
        three = s[:-2] * _S3 + s[1:-1] * _S2 + s[2:]
        runs = np.where(same[1:] & same[:-1], _SAME * _S3, three)
        grams = np.concatenate([w, pairs, s ^ _S2, two, runs]) * _S3
    return np.unique((grams >> np.uint64(46)).astype(np.int32))


@dataclass
class Model:
    weights: np.ndarray  # of the scaled indicators' columns, ratios included
    ratios: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, columns: np.ndarray) -> float:
        norm = float(np.sqrt((self.ratios[columns] ** 2).sum()))
        return self.bias + (float(self.weights[columns].sum()) / norm if norm else 0.0)

    def score(self, columns: np.ndarray) -> float:
        z = self.slope * self.margin(columns) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, columns: int = COLUMNS, smooth: float = SMOOTH) -> np.ndarray:
    """log of the ratio of each column's share of the set indicators in either class."""
    out = []
    for label in (1, 0):
        own = [r for r, y in zip(rows, labels) if y == label]
        counts = np.bincount(np.concatenate(own) if own else np.empty(0, dtype=np.int32), minlength=columns) + smooth
        out.append(np.log(counts / counts.sum()))
    return (out[0] - out[1]).astype(np.float64)


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, columns: int, bound: float = BOUND, passes: int = PASSES, seed: int = 3) -> tuple[np.ndarray, float]:
    """Hinge-loss weights and bias: one dual variable at a time moves to its best place in [0, bound]."""
    w, bias = np.zeros(columns), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float((v**2).sum()) + 1.0 for v in values])  # the bias is one more column that is always set
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = signs[i] * (float(w[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), bound)
            step = (new - alpha[i]) * signs[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def logistic(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the curve, by Newton's method with a small penalty; the slope stays positive."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -60, 60)))
        g = np.array([(weights * (p - labels) * margins).sum() + 1e-2 * (a - 1), (weights * (p - labels)).sum() + 1e-2 * b])
        h = weights * p * (1 - p)
        hess = np.array([[(h * margins**2).sum() + 1e-2, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-2]])
        step = np.linalg.solve(hess, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


class _Scaled:
    """The values of each row's columns, ratios scaled to unit length; made when asked for, as all at once are many."""

    def __init__(self, rows: list[np.ndarray], ratios: np.ndarray):
        self.rows, self.ratios = rows, ratios
        self.scale = [1 / max(1e-12, float(np.sqrt((ratios[r] ** 2).sum()))) for r in rows]

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ratios[self.rows[i]] * self.scale[i]

    def __len__(self) -> int:
        return len(self.rows)

    def __iter__(self) -> Iterator[np.ndarray]:
        return (self[i] for i in range(len(self)))


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, share: float | None = None, columns: int = COLUMNS) -> Model:
    """The model of these feature rows; ``share`` is class 1's part of all labelled rows, for the curve."""
    if not len(rows) or len(set(labels.tolist())) < 2:
        sure = 0.0 if not len(rows) else 8.0 if labels[0] == 1 else -8.0
        return Model(np.zeros(columns), np.zeros(columns), 0.0, 1.0, sure)
    rest = np.arange(len(rows)) % max(2, round(1 / CALIBRATE)) == 0
    if len(rows) < 50 or len(set(labels[~rest].tolist())) < 2:
        rest[:] = False
    inside = np.flatnonzero(~rest)
    ratios = log_count_ratios([rows[i] for i in inside], labels[inside], columns)
    values = _Scaled(rows, ratios)
    w, bias = dual_descent([rows[i] for i in inside], _Scaled([rows[i] for i in inside], ratios), np.where(labels[inside] == 1, 1.0, -1.0), columns)
    at = np.flatnonzero(rest) if rest.any() else inside
    margins = np.array([float(w[rows[i]] @ values[i]) + bias for i in at])
    y = labels[at].astype(float)
    share = float(y.mean()) if share is None else share
    weights = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    slope, offset = logistic(margins, y, weights)
    return Model(w * ratios, ratios, bias, slope, offset)


@common.tidy
def _feature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    common.only(_words)
    for batch in batches:
        out = batch.drop(columns="text")
        out["columns"] = [features(t) for t in batch["text"]]
        yield out


@common.tidy
def _score(batches: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    common.only(_words)
    for batch in batches:
        out = batch.drop(columns="text")
        out["score"] = [model.score(features(t)) for t in batch["text"]]
        yield out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on ``docs(doc_id, text)`` and ``labels(doc_id, label)``; the ids drawn are few enough to broadcast."""
    ship(docs.sparkSession)
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("label").cast("int").alias("label"))
    known = stage(known, "labels")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    # the first of each class by hashed id
    one, zero = (
        known.where((F.col("label") == c) & common.drawn(F.col("doc_id"), per_class, counts.get(c, 0))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        for c in (1, 0)
    )
    drawn = one.unionByName(zero)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    rows = texts.mapInPandas(_feature_rows, "doc_id long, label int, columns array<int>")
    rows = common.local(rows)
    rows["order"] = [xxhash.xxh64_intdigest(str(i).encode()) for i in rows["doc_id"]]
    rows = rows.sort_values(["order", "doc_id"], kind="stable")
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit_rows([np.asarray(c, dtype=np.int32) for c in rows["columns"]], rows["label"].to_numpy(), share)


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` columns with ``score`` for each row of ``docs(text)``."""
    ship(docs.sparkSession)
    small = Model(model.weights.astype(np.float32), model.ratios.astype(np.float32), model.bias, model.slope, model.offset)
    rows = docs.select(*keep, "text")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    return rows.mapInPandas(functools.partial(_score, model=small), f"{kept}, score double")


@common.tidy
def _keep(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    common.only(_words)
    for batch in batches:
        good = [model.score(features(t)) >= threshold for t in batch.column("text").to_pylist()]
        yield batch.filter(pa.array(good, pa.bool_()))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    ship(docs.sparkSession)
    small = Model(model.weights.astype(np.float32), model.ratios.astype(np.float32), model.bias, model.slope, model.offset)
    return docs.mapInArrow(functools.partial(_keep, model=small, threshold=threshold), docs.schema)


def fit_quality(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn ``labels.quality`` from the rows whose id's crc32 modulo 5 is not 0."""
    quality = labels.select("doc_id", F.col("quality").alias("label")).where(crc_mod(F.col("doc_id"), 5) != 0)
    return fit(docs, quality)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and prediction of every row of ``docs(doc_id, text)``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 0)
    scored = score(rows, fit_quality(docs, labels), "doc_id", "held_out")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, made along a tree of its leading bits. For each decision the model holds, at every
depth from 0 to ``depth``, the zeros and ones that training texts had after the last so many bytes. A node's weighted
probability mixes, half and half, the Krichevsky-Trofimov block probability of its own counts with the product of its
children's weighted probabilities; the share of the first in the mixture is the node's weight when it predicts. A
context that training never had adds nothing: the deepest one it had predicts. Texts are bytes with A-Z lower-cased,
preceded by ``depth`` null bytes and followed by an end mark that is no byte of UTF-8.

One pass over the texts gathers all byte sequences of length ``depth + 1``, with their numbers in training and in all
texts. They are dealt into blocks of a bounded size by the last three bytes of their contexts. A block is a whole part
of the tree below these bytes: one task builds it and gives the probability of each of its sequences, in training or
not, as one row. The nodes above, of contexts of at most two bytes, need sums from all blocks, one row for each node.
A second pass over the texts adds up the probabilities: those of frequent sequences, at most a fixed number, are
looked up in each task; the others are joined by key as rows.

The base model is a word unigram. Frequent words, at most a fixed number, are looked up alike, the others joined.
What is frequent is counted over all texts, so no key that is joined has more than a small part of the rows.

A probability is kept as that of the bit that comes, never as one minus that of the other, and both shares of a
mixture are kept, so that scores are finite at any counts.

Cases: a null text counts as empty and is scored for its end; a null doc_id has the checksum of an empty text and is
scored like any other; repeated rows train and score as often as they stand; very long texts are scored whole; words
of equal count are all frequent or none of them is; without training rows every bit has one half; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, local, ship, stage

#: Bytes of context; sequences in a block, about; frequent sequences and frequent words that every task holds.
DEPTH, BLOCK, HEAD_CODES, HEAD = 5, 400_000, 1_000_000, 100_000
#: Context bytes that deal sequences into blocks.
TOP = 3
END = 0xFF
#: Bytes that are worked on at once, distinct words and sequences that a task counts before it emits them.
AT_ONCE, HELD = 2_000_000, 400_000
U = np.uint64


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for positive numbers, by Stirling's series above 8."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift - np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1, y)
    r = 1 / (y * y)
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / y


def log_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of any sequence with ``a`` zeros and ``b`` ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - math.log(math.pi)


def sequences(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and end of the texts its context and itself as one number, and each text's first place."""
    pad = bytes(depth)
    buffer = np.frombuffer(pad.join([b"", *[t + bytes([END]) for t in texts]]), dtype=np.uint8)
    n = len(buffer) - depth
    code = np.zeros(n, dtype=np.uint64)
    for i in range(depth + 1):
        code = (code << U(8)) | buffer[i : i + n]
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes + depth) - (sizes + depth)
    keep = np.ones(n, dtype=bool)
    for i in range(depth):  # the padding between texts is not predicted
        keep[(starts[1:] - depth + i)[starts[1:] - depth + i < n]] = False
    return code[keep], np.cumsum(sizes) - sizes


def runs(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal neighbours of sorted codes as one, with the sum of their counts."""
    if not len(codes):
        return codes, counts
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(counts, first)


class Level:
    """Nodes of one depth and one number of leading bits, by key: the context's bytes, then the bits."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        self.weight, self.rest = np.ones(len(keys)), np.zeros(len(keys))
        self.log_weighted = log_block(zeros, ones)

    def mix(self, below: np.ndarray) -> None:
        """``below``: sum of the children's log weighted probabilities."""
        own, below = self.log_weighted + math.log(0.5), below + math.log(0.5)
        self.log_weighted = np.logaddexp(own, below)
        self.weight, self.rest = np.exp(own - self.log_weighted), np.exp(below - self.log_weighted)

    def predict(self, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """The nodes' own estimates of the bits that come."""
        zeros, ones = self.zeros[at], self.ones[at]
        return (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1.0)


def levels(codes: np.ndarray, counts: np.ndarray, depth: int) -> list[Level]:
    """The eight levels of a depth; ``codes`` are sorted sequences of ``depth + 1`` bytes."""
    out = []
    for j in range(8):
        keys = codes >> U(8 - j)
        bit = ((codes >> U(7 - j)) & U(1)).astype(bool)
        zeros, ones = np.where(bit, 0, counts), np.where(bit, counts, 0)
        names, z = runs(keys, zeros)
        out.append(Level(names, z.astype(np.float64), runs(keys, ones)[1].astype(np.float64)))
    return out


def shorter(codes: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of sequences with a context of ``depth`` bytes, from longer ones."""
    cut = codes & U((1 << 8 * (depth + 1)) - 1)
    order = np.argsort(cut, kind="stable")
    return runs(cut[order], counts[order])


def children(parents: Level, kids: Level, depth: int, j: int) -> np.ndarray:
    at = np.searchsorted(parents.keys, kids.keys & U((1 << (8 * depth + j)) - 1))
    return np.bincount(at, weights=kids.log_weighted, minlength=len(parents.keys))


def subtree(codes: np.ndarray, counts: np.ndarray, depth: int, top: int, whole: bool = True) -> dict[int, list[Level]]:
    """Mixed levels of the depths from ``top`` to ``depth`` of the contexts in a block; only ``top`` if not ``whole``."""
    out: dict[int, list[Level]] = {}
    for d in range(depth, top - 1, -1):
        if d < depth:
            codes, counts = shorter(codes, counts, d)
        out[d] = levels(codes, counts, d)
        if d < depth:
            for j in range(8):
                out[d][j].mix(children(out[d][j], out[d + 1][j], d, j))
                out[d + 1][j].log_weighted = None
            if not whole:
                del out[d + 1]
    return out


def log10_of(codes: np.ndarray, nodes: dict[int, list[Level]], depth: int) -> np.ndarray:
    """log10 of the probability of each sequence's last byte after the others."""
    out = np.zeros(len(codes))
    for j in range(8):
        bit = ((codes >> U(7 - j)) & U(1)).astype(bool)
        p, some = np.full(len(codes), 0.5), np.zeros(len(codes), dtype=bool)
        for d in range(depth, -1, -1):
            level = nodes[d][j]
            if not len(level.keys):
                continue
            key = (codes & U((1 << 8 * (d + 1)) - 1)) >> U(8 - j)
            at = np.minimum(np.searchsorted(level.keys, key), len(level.keys) - 1)
            here = level.keys[at] == key
            own = level.predict(at, bit)
            # the deepest context that training had predicts alone
            mixed = np.where(some, level.weight[at] * own + level.rest[at] * p, own)
            p = np.where(here, mixed, p)
            some |= here
        out += np.log10(p)
    return out


class Table:
    """Values of some sequences, by open addressing."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        bits = max(10, int(3 * max(1, len(codes)) - 1).bit_length())
        self.shift, self.mask = U(64 - bits), U((1 << bits) - 1)
        self.keys = np.full(1 << bits, U((1 << 64) - 1))
        self.values = np.zeros(1 << bits)
        slot, self.steps = self._slot(codes), 0
        while len(codes):
            self.steps += 1
            free = self.keys[slot] == U((1 << 64) - 1)
            self.keys[slot[free]] = codes[free]  # of those that want one slot the last gets it
            won = self.keys[slot] == codes
            self.values[slot[won]] = values[won]
            codes, values, slot = codes[~won], values[~won], (slot[~won] + U(1)) & self.mask

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (codes * U(0x9E3779B97F4A7C15)) >> self.shift

    def get(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of each sequence, 0 where there is none, and the places of these."""
        slot = self._slot(codes)
        hit = self.keys[slot] == codes
        out = np.where(hit, self.values[slot], 0.0)
        rest = np.flatnonzero(~hit)
        for _ in range(1, self.steps):
            if not len(rest):
                break
            slot = (slot[~hit] + U(1)) & self.mask
            hit = self.keys[slot] == codes[rest]
            out[rest[hit]] = self.values[slot[hit]]
            rest = rest[~hit]
        return out, rest


def prepared(text: str | None) -> bytes:
    return (b"" if text is None else text.encode("utf-8", "surrogatepass")).lower()


def _groups(texts: list[bytes]) -> Iterator[slice]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > AT_ONCE:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


_GATHERED = "word binary, code long, n long, every long"


def _gather(batches: Iterator[pd.DataFrame], depth: int) -> Iterator[pd.DataFrame]:
    """Numbers in training (``n``) and in all texts (``every``) of words (word) and sequences (code); a row with
    neither counts the ends."""
    words: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    ends = [0, 0]

    def word_rows() -> pd.DataFrame:
        own, other = words
        names = list(own.keys() | other.keys())
        n = [own[w] for w in names]
        return pd.DataFrame({"word": names, "code": pd.array([None] * len(names), dtype="Int64"), "n": n, "every": [a + other[w] for a, w in zip(n, names)]})

    def code_rows() -> pd.DataFrame:
        codes, n, every = held[0]
        return pd.DataFrame({"word": None, "code": pd.array(codes.view(np.int64), dtype="Int64"), "n": n, "every": every})

    for batch in batches:
        for train, part in batch.groupby("train"):
            texts = [prepared(t) for t in part["text"]]
            ends[0] += len(texts) if train else 0
            ends[1] += len(texts)
            for at in _groups(texts):
                for t in texts[at]:
                    words[not train].update(t.split())
                codes, _ = sequences(texts[at], depth)
                codes.sort()
                codes, every = runs(codes, np.ones(len(codes), dtype=np.int64))
                held.append((codes, every if train else np.zeros_like(every), every))
                if len(held) > 1:
                    codes = np.concatenate([h[0] for h in held])
                    order = np.argsort(codes, kind="stable")
                    codes = codes[order]
                    held = [(*runs(codes, np.concatenate([h[1] for h in held])[order]), runs(codes, np.concatenate([h[2] for h in held])[order])[1])]
                if sum(map(len, words)) > HELD:
                    yield word_rows()
                    for w in words:
                        w.clear()
                if len(held[0][0]) > 3 * HELD:
                    yield code_rows()
                    held = []
    if any(words):
        yield word_rows()
    if held:
        yield code_rows()
    yield pd.DataFrame({"word": [None], "code": pd.array([None], dtype="Int64"), "n": [ends[0]], "every": [ends[1]]})


def _trained(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of a block that training had, in order, and their numbers."""
    codes, n = frame["code"].to_numpy("int64").view(np.uint64), frame["n"].to_numpy("int64")
    codes, n = codes[n > 0], n[n > 0]
    order = np.argsort(codes)
    return codes[order], n[order]


def _summaries(key, frame: pd.DataFrame, depth: int, top: int) -> pd.DataFrame:
    """What a block adds to the nodes of depth ``top - 1``: their children's counts and log probabilities."""
    own = subtree(*_trained(frame), depth, top, whole=False)[top]
    out = []
    for j, level in enumerate(own):
        parent = level.keys & U((1 << (8 * (top - 1) + j)) - 1)
        names, at = np.unique(parent, return_inverse=True)
        sums = [np.bincount(at, weights=x, minlength=len(names)) for x in (level.zeros, level.ones, level.log_weighted)]
        out.append(pd.DataFrame({"bits": j, "node": names.view(np.int64), "zeros": sums[0], "ones": sums[1], "below": sums[2]}))
    return pd.concat(out)


def top_levels(rows: pd.DataFrame, top: int) -> dict[int, list[Level]]:
    """Mixed levels of the depths below ``top``, from the blocks' sums."""
    out: dict[int, list[Level]] = {}
    for d in range(top - 1, -1, -1):
        out[d] = []
        for j in range(8):
            if d == top - 1:
                own = rows[rows["bits"] == j].sort_values("node")
                level = Level(own["node"].to_numpy("int64").view(np.uint64), own["zeros"].to_numpy("float64"), own["ones"].to_numpy("float64"))
                level.mix(own["below"].to_numpy("float64"))
            else:
                kids = out[d + 1][j]
                names, at = np.unique(kids.keys & U((1 << (8 * d + j)) - 1), return_inverse=True)
                level = Level(names, np.bincount(at, weights=kids.zeros, minlength=len(names)), np.bincount(at, weights=kids.ones, minlength=len(names)))
                level.mix(np.bincount(at, weights=kids.log_weighted, minlength=len(names)))
            out[d].append(level)
    for level in sum(out.values(), []):
        level.log_weighted = None
    return out


class Model:
    """What scoring needs: values of all sequences and counts of all words as tables, and the frequent ones of both."""

    def __init__(self, depth: int, values: DataFrame, counts: DataFrame, head, tokens: int, distinct: int):
        self.depth, self.values, self.counts, self.head, self.tokens, self.distinct = depth, values, counts, head, tokens, distinct


def fit(docs: DataFrame, depth: int = DEPTH, block: int = BLOCK, head: int = HEAD, head_codes: int = HEAD_CODES) -> Model:
    """Learn from the rows of ``docs(text, train)`` where ``train`` holds; the others' sequences get values as well."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    ship(spark)
    top = min(TOP, depth)
    raw = stage(docs.select("text", "train").mapInPandas(functools.partial(_gather, depth=depth), _GATHERED), "counted")
    sums = [F.sum("n").alias("n"), F.sum("every").alias("every")]
    counts = stage(raw.where("word is not null").groupBy("word").agg(*sums), "words")
    ends = raw.where("word is null and code is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    distinct, tokens = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    codes = raw.where("code is not null").groupBy("code").agg(*sums)
    codes = stage(codes, "codes")
    blocks = max(1, -(-codes.count() // block))
    context = F.shiftright("code", 8).bitwiseAND(F.lit((1 << 8 * top) - 1))
    dealt = codes.withColumn("block", F.pmod(F.xxhash64(context), F.lit(blocks)).cast("int"))

    def summaries(key, frame: pd.DataFrame) -> pd.DataFrame:
        return _summaries(key, frame, depth, top)

    # a node's sums come from the few blocks of its context; there are at most 2**24 nodes, far fewer in UTF-8 text
    tops = dealt.groupBy("block").applyInPandas(summaries, "bits int, node long, zeros double, ones double, below double")
    tops = tops.groupBy("bits", "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below"))
    upper = sc.broadcast(top_levels(local(tops), top))

    def values_of(key, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"code": frame["code"], "value": _values(frame, upper.value, depth, top), "every": frame["every"]})

    values = stage(dealt.groupBy("block").applyInPandas(values_of, "code long, value double, every long"), "values")
    frequent = local(values.where(F.col("every") >= _head_count(values, head_codes)).select("code", "value"))
    words = local(counts.where(F.col("every") >= _head_count(counts, head)).select("word", "n"))
    known = {bytes(w): int(n) for w, n in zip(words["word"], words["n"])}
    shared = sc.broadcast((frequent["code"].to_numpy("int64").view(np.uint64), frequent["value"].to_numpy("float64"), known, int(ends)))
    return Model(depth, values, counts, shared, int(tokens) + int(ends), int(distinct) + (ends > 0))


def _values(frame: pd.DataFrame, upper: dict[int, list[Level]], depth: int, top: int) -> np.ndarray:
    """log10 probability of every sequence of a block."""
    return log10_of(frame["code"].to_numpy("int64").view(np.uint64), upper | subtree(*_trained(frame), depth, top), depth)


def _head_count(counts: DataFrame, head: int) -> int:
    """The least count for which at most ``head`` keys have it or more, from a histogram of a few hundred steps."""
    step = F.floor(F.log2(F.col("every").cast("double")) * 16)
    rows = counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("words"), F.min("every").alias("least")).orderBy(F.desc("s")).collect()
    total, least = 0, 1 << 62
    for r in rows:
        total += r["words"]
        if total > head:
            break
        least = r["least"]
    return least


def _base_of(n: int, tokens: int, distinct: int) -> float:
    return math.log10((n + 0.5) / (tokens + 0.5 * (distinct + 1)))


_last: list = [None, None]


def _table(head) -> Table:
    """The table of a broadcast head; a worker builds it once and keeps the last."""
    if _last[0] is not head:
        _last[:] = [None, None]
        _last[:] = [head, Table(*head.value[:2])]
    return _last[1]


_ROWS = "row long, doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double, word binary, code long, n long"


def _typed(frame: pd.DataFrame) -> pd.DataFrame:
    frame["doc_id"], frame["code"] = frame["doc_id"].astype("Int64"), frame["code"].astype("Int64")
    frame["held_out"] = frame["held_out"].astype("boolean")
    return frame[[f.split()[0] for f in _ROWS.split(", ")]]


def _look_up(batches: Iterator[pd.DataFrame], depth: int, head, tokens: int, distinct: int) -> Iterator[pd.DataFrame]:
    """Rows of texts with what their frequent words and sequences give, and rows of their other words and sequences."""
    table, (_, _, known, ends) = _table(head), head.value
    logs = {w: _base_of(n, tokens, distinct) for w, n in known.items()}
    end_log = _base_of(ends, tokens, distinct)
    none = {"doc_id": None, "held_out": None, "n_bytes": 0, "n_tokens": 0, "n_known": 0, "base_score": 0.0, "score": 0.0}
    for batch in batches:
        texts = [prepared(t) for t in batch["text"]]
        for at in _groups(texts):
            parts, numbers = texts[at], batch["row"].iloc[at].to_numpy("int64")
            codes, starts = sequences(parts, depth)
            values, missing = table.get(codes)
            scores = np.add.reduceat(values, starts)
            rows, rare_row, rare_word, rare_n = [], [], [], []
            for number, doc_id, held_out, text, score in zip(numbers, batch["doc_id"].iloc[at], batch["held_out"].iloc[at], parts, scores):
                total, n_known, base = 1, int(ends > 0), end_log
                for w, n in Counter(text.split()).items():
                    total += n
                    v = logs.get(w)
                    if v is None:
                        rare_row.append(number)
                        rare_word.append(w)
                        rare_n.append(n)
                    else:
                        n_known += n if known[w] else 0
                        base += n * v
                rows.append((number, doc_id, held_out, len(text) + 1, total, n_known, base, float(score)))
            out = pd.DataFrame(rows, columns=["row", "doc_id", "held_out", "n_bytes", "n_tokens", "n_known", "base_score", "score"])
            yield _typed(out.assign(word=None, code=None, n=0))
            if rare_row:
                yield _typed(pd.DataFrame({"row": rare_row, "word": rare_word, "n": rare_n}).assign(code=None, **none))
            if len(missing):
                pair = pd.DataFrame({"row": numbers[np.searchsorted(starts, missing, side="right") - 1], "code": codes[missing].view(np.int64)})
                pair = pair.groupby(["row", "code"], sort=False).size().rename("n").reset_index()
                yield _typed(pair.assign(word=None, **none))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Scores of each row of ``docs(doc_id, text, held_out)``, texts that ``fit`` was given, for training or not."""
    ship(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out")
    run = functools.partial(_look_up, depth=model.depth, head=model.head, tokens=model.tokens, distinct=model.distinct)
    first = stage(rows.mapInPandas(run, _ROWS), "scored")
    texts = first.where("word is null and code is null").drop("word", "code", "n")
    one = F.log10((F.col("c") + 0.5) / F.lit(model.tokens + 0.5 * (model.distinct + 1)))
    words = first.where("word is not null").select("row", "word", "n").join(model.counts.select("word", F.col("n").alias("c")), "word")
    words = words.select("row", F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("known"), (F.col("n") * one).alias("base"), F.lit(0.0).alias("more"))
    codes = first.where("code is not null").select("row", "code", "n").join(model.values.select("code", "value"), "code")
    codes = codes.select("row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), (F.col("n") * F.col("value")).alias("more"))
    sums = words.unionByName(codes).groupBy("row").agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("more").alias("more"))
    out = texts.join(sums, "row", "left")
    for name, extra in (("n_known", "known"), ("base_score", "base"), ("score", "more")):
        out = out.withColumn(name, F.col(name) + F.coalesce(F.col(extra), F.lit(0)))
    bits = (F.col("score") / F.lit(-math.log10(2)) / F.col("n_bytes")).alias("bits_per_byte")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", bits)


def judge(docs: DataFrame, depth: int = DEPTH, block: int = BLOCK, head: int = HEAD, head_codes: int = HEAD_CODES) -> DataFrame:
    """Learn from the rows whose id's crc32 modulo 5 is not 1, score all rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 1)
    return score(rows, fit(rows.select("text", (~F.col("held_out")).alias("train")), depth, block, head, head_codes))

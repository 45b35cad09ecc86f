"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors get one more component that makes all of them equally long, so that the largest inner product is the smallest
distance. A bounded sample is split again and again into a few clusters until every cluster is small: the leaves'
centres are the lists, in proportion to the vectors up to a bound. Every vector goes to the list of its nearest centre
and, if it lies near a boundary, to further ones whose distance is within a ratio of the least. A query searches the
centres on a graph of their neighbours that each task holds in memory: from the centres found so far, the search goes
on to the neighbours of all that lie within the ratio of the nearest, and the query reads the lists of these.

Lists that lie near each other share a bucket of bounded size; a longer list has several. Each vector goes to a bucket
once, with its lists there, and each query likewise. A task reads the vectors of a bucket, then its queries as a
stream of any length, and passes on the best of each query. Every vector is indexed.

Equal vectors are one entry with their smallest ids: as ties go to smaller ids, no other of them can be in a result.

Cases: vectors that are null or zero, or hold nulls, NaN or infinities, take no part, nor do those of another length
than the most common one (ties: the shorter); ties in score go to the smaller vec_id; a row is never its own
neighbour, but an equal vector of another row is; rows that share a vec_id count as one row if their vectors are equal;
with fewer candidates than asked for, all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drawn, sent_if_small, ship, spread_join, stage

#: Vectors of the sample in a leaf, and vectors that fit the centres at most; there is a list for each leaf.
LEAF, SAMPLE = 128, 1 << 18
#: Leaves at most; where a sample would have more, its leaves are larger.
MOST_LISTS = 8192
#: A vector goes to at most COPIES lists, those within CLOSE times its least distance.
COPIES, CLOSE = 2, 1.05
#: A query reads the lists within RATIO times its least distance.
RATIO = 1.15
#: The search goes on from centres within so much more than the ratio; neighbours of a centre in the graph.
SLACK, DEGREE = 1.2, 24
#: Vectors in a bucket.
BUCKET = 8192


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def entries(vectors: DataFrame, k: int) -> DataFrame:
    """``(gid, vector, ids)``: distinct usable vectors, their smallest id, and their ``k + 1`` smallest ids."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        rows = rows.where(F.lit(False))
    else:
        rows = rows.where(F.size("vector") == sizes["n"])
    # Spark keeps the first few of each group before it shuffles, so a vector with many copies stays small
    by = Window.partitionBy("vector").orderBy("vec_id")
    rows = rows.select("vec_id", "vector").withColumn("nth", F.dense_rank().over(by)).where(F.col("nth") <= k + 1)
    return rows.groupBy("vector").agg(F.min("vec_id").alias("gid"), F.array_sort(F.collect_set("vec_id")).alias("ids"))


def lift(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that makes their length ``longest``."""
    rest = np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1), 0))
    return np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(d, 0))


def _split(x: np.ndarray, ways: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Labels of a k-means that prefers clusters of equal size: a cluster's distance grows with its share."""
    centres = x[rng.choice(len(x), ways, replace=False)]
    weight = np.zeros(ways, dtype=np.float32)
    label = np.zeros(len(x), dtype=np.int64)
    for _ in range(rounds):
        d = distances(x, centres)
        label = (d + weight[None, :] * d.mean()).argmin(axis=1)
        share = np.bincount(label, minlength=ways) / len(x)
        weight = 0.5 * weight + 0.5 * np.maximum(share * ways - 1, 0).astype(np.float32) * 0.2
        for c in range(ways):
            own = x[label == c]
            if len(own):
                centres[c] = own.mean(axis=0)
    return label


def fit_centres(x: np.ndarray, leaf: int = LEAF, ways: int = 8, seed: int = 5) -> np.ndarray:
    """Centres of the leaves of repeated splits."""
    rng, todo, out = np.random.default_rng(seed), [x], []
    while todo:
        part = todo.pop()
        if len(part) <= leaf:
            out.append(part.mean(axis=0))
            continue
        label = _split(part, min(ways, -(-len(part) // leaf)), rng)
        names, counts = np.unique(label, return_counts=True)
        small = counts < leaf / 4
        if small.any() and not small.all():  # too few for a list of their own: they go to the nearest of the others
            means = np.array([part[label == c].mean(axis=0) for c in names[~small]])
            lone = np.isin(label, names[small])
            label[lone] = names[~small][distances(part[lone], means).argmin(axis=1)]
        pieces = [part[label == c] for c in np.unique(label)]
        if len(pieces) == 1:  # cannot be told apart
            out.append(part.mean(axis=0))
        else:
            todo += pieces
    return np.array(out, dtype=np.float32)


def neighbour_graph(centres: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """For each centre its nearest others, and a few at random so that walks reach everywhere."""
    n = len(centres)
    near = min(degree, n - 1)
    if near < 1:
        return np.zeros((n, 1), dtype=np.int64)
    out = np.empty((n, near), dtype=np.int64)
    for i in range(0, n, 512):
        d = distances(centres[i : i + 512], centres)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out[i : i + 512] = np.argpartition(d, near - 1, axis=1)[:, :near]
    far = np.random.default_rng(11).integers(0, n, size=(n, 4))
    return np.concatenate([out, far], axis=1)


def walk(x: np.ndarray, centres: np.ndarray, graph: np.ndarray, ratio: float, sizes: np.ndarray | None = None, least: int = 0) -> np.ndarray:
    """For each of some queries, which centres the search found within ``ratio`` times the distance of the nearest.

    Where the lists of these, of ``sizes`` vectors, have fewer than ``least`` together, the next nearest come too.

    All centres within a little more than the ratio of the best so far are opened at once, and their neighbours
    measured; the search of a query ends when there is none left to open. Whatever the ratio, the nearest is opened."""
    n = len(centres)
    start = np.unique(np.linspace(0, n - 1, min(n, 64)).astype(np.int64))
    dist = np.full((len(x), n), np.inf, dtype=np.float32)
    dist[:, start] = distances(x, centres[start])
    opened = np.zeros(dist.shape, dtype=bool)
    lengths, own = (centres**2).sum(axis=1), (x**2).sum(axis=1)
    while True:
        row, col = np.nonzero((dist <= SLACK * ratio * dist.min(axis=1, keepdims=True) + 1e-6) & ~opened)
        if not len(row):
            break
        opened[row, col] = True
        reached = np.zeros(dist.shape, dtype=bool)
        reached[row[:, None], graph[col]] = True
        row, col = np.nonzero(reached & np.isinf(dist))
        for i in range(0, len(row), 1 << 17):
            r, c = row[i : i + (1 << 17)], col[i : i + (1 << 17)]
            dist[r, c] = np.sqrt(np.maximum(own[r] + lengths[c] - 2 * np.einsum("ij,ij->i", x[r], centres[c]), 0))
    use = dist <= ratio * dist.min(axis=1, keepdims=True) + 1e-6
    if least:
        short = np.flatnonzero(use @ sizes < min(least, sizes.sum()))
        order = distances(x[short], centres).argsort(axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        more = np.zeros((len(short), n), dtype=bool)
        np.put_along_axis(more, order, before < least, axis=1)
        use[short] |= more
    return use


def _matrix(column: pd.Series, kind=np.float64) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(kind, copy=False) if len(column) else np.empty((0, 0), dtype=kind)


def _with_lists(part: pd.DataFrame, use: np.ndarray) -> pd.DataFrame:
    row, col = np.nonzero(use)
    out = part.copy()
    out["lists"] = np.split(col.astype("int32"), np.searchsorted(row, np.arange(1, len(part))))
    return out


def _assign(batches: Iterator[pd.DataFrame], centres: np.ndarray, longest: float, copies: int, close: float) -> Iterator[pd.DataFrame]:
    """Each vector with the lists it goes to."""
    for batch in batches:
        for i in range(0, len(batch), 512):
            part = batch.iloc[i : i + 512]
            d = distances(lift(_matrix(part["vector"]), longest), centres)
            many = min(copies, len(centres))
            near = np.argpartition(d, many - 1, axis=1)[:, :many]
            gap = np.take_along_axis(d, near, axis=1)
            use = np.zeros(d.shape, dtype=bool)
            np.put_along_axis(use, near, gap <= close * gap.min(axis=1, keepdims=True) + 1e-6, axis=1)
            yield _with_lists(part, use)


def _probe(batches: Iterator[pd.DataFrame], centres: np.ndarray, graph: np.ndarray, longest: float, ratio: float, sizes: np.ndarray, least: int) -> Iterator[pd.DataFrame]:
    """Each query with the lists it reads."""
    for batch in batches:
        for i in range(0, len(batch), 256):
            part = batch.iloc[i : i + 256]
            v = _matrix(part["vector"])
            # a query's length changes no order: it is made that of the lifted vectors, and the component added is zero
            v = v * (longest / np.sqrt((v**2).sum(axis=1, keepdims=True)))
            x = np.concatenate([v, np.zeros((len(v), 1))], axis=1).astype(np.float32)
            yield _with_lists(part, walk(x, centres, graph, ratio, sizes, least))


class _Bucket:
    """The vectors of a bucket: those of one list stand together, in the order of their ids."""

    def __init__(self, frame: pd.DataFrame):
        x, gid = _matrix(frame["vector"]), frame["gid"].to_numpy("int64")
        row = np.repeat(np.arange(len(frame)), frame["lists"].map(len).to_numpy())
        name = np.concatenate(frame["lists"].to_numpy())
        order = np.lexsort((gid[row], name))
        self.names, first = np.unique(name[order], return_index=True)
        self.members = np.split(row[order], first[1:])
        self.x, self.gid = x, gid

    def best(self, queries: pd.DataFrame, k: int) -> pd.DataFrame:
        """The best ``k + 1`` vectors of the lists that each query reads here."""
        q, qid = _matrix(queries["vector"]), queries["gid"].to_numpy("int64")
        row = np.repeat(np.arange(len(queries)), queries["lists"].map(len).to_numpy())
        name = np.concatenate(queries["lists"].to_numpy())
        order = np.argsort(name, kind="stable")
        names, first = np.unique(name[order], return_index=True)
        who, which, how = [], [], []
        for one, rows in zip(names, np.split(row[order], first[1:])):
            at = np.searchsorted(self.names, one)
            if at == len(self.names) or self.names[at] != one:
                continue
            own = self.members[at]
            s = q[rows] @ self.x[own].T
            many = min(k + 1, len(own))
            # all as good as the last that is wanted stay, so that ties are settled by id later
            last = np.partition(s, len(own) - many, axis=1)[:, len(own) - many]
            r, c = np.nonzero(s >= last[:, None] - 1e-9 * np.abs(last[:, None]))
            who.append(rows[r]), which.append(own[c]), how.append(s[r, c])
        if not who:
            return pd.DataFrame({"qid": np.array([], "int64"), "gid": np.array([], "int64"), "score": np.array([], "float64")})
        who, which, how = map(np.concatenate, (who, which, how))
        # a vector may stand in several lists; near the last place its score decides, so a few more than wanted stay
        order = np.lexsort((self.gid[which], -how, who))
        who, which = who[order], which[order]
        new = np.ones(len(who), dtype=bool)
        pair = who * np.int64(len(self.gid)) + which
        new[np.setdiff1d(np.arange(len(pair)), np.unique(pair, return_index=True)[1])] = False
        who, which = who[new], which[new]
        nth = np.arange(len(who)) - np.searchsorted(who, who)
        keep = nth < 2 * (k + 1)
        who, which = who[keep], which[keep]
        score = np.einsum("ij,ij->i", q[who], self.x[which])
        order = np.lexsort((self.gid[which], -score, who))
        who, which, score = who[order], which[order], score[order]
        keep = np.arange(len(who)) - np.searchsorted(who, who) < k + 1
        return pd.DataFrame({"qid": qid[who[keep]], "gid": self.gid[which[keep]], "score": score[keep]})


def _stream(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Buckets one after the other, each with its vectors first and then its queries."""
    now, held, bucket = None, [], None
    for batch in batches:
        change = np.flatnonzero(np.diff(batch["bucket"].to_numpy()) | np.diff(batch["asks"].to_numpy("int8"))) + 1
        for part in np.split(np.arange(len(batch)), change):
            rows = batch.iloc[part]
            if rows["bucket"].iloc[0] != now:
                now, held, bucket = rows["bucket"].iloc[0], [], None
            if not rows["asks"].iloc[0]:
                held.append(rows)
                continue
            if bucket is None and held:
                bucket, held = _Bucket(pd.concat(held)), []
            if bucket is not None:
                yield bucket.best(rows, k)


def _buckets(sizes: list[int]) -> tuple[list[int], list[int]]:
    """The first bucket of each list, and how many it has; neighbouring short lists share one."""
    first, parts, at, filled = [], [], 0, 0
    for size in sizes:
        if filled and filled + size > BUCKET:
            at, filled = at + 1, 0
        first.append(at)
        parts.append(max(1, -(-size // BUCKET)))
        if parts[-1] > 1:
            at += parts[-1]
        else:
            filled += size
    return first, parts


def search(vectors: DataFrame, queries: Column, k: int = 20, ratio: float = RATIO) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``vectors(vec_id, embedding)`` where ``queries`` holds, its
    ``k`` nearest among all other rows."""
    spark = vectors.sparkSession
    ship(spark)
    index = stage(entries(vectors, k), "entries")
    size, longest = index.agg(F.count(F.lit(1)), F.max(F.aggregate("vector", F.lit(0.0), lambda t, x: t + x.cast("double") * x))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not size:
        return empty
    longest = longest**0.5
    sample = index.select("gid", "vector").where(drawn(F.col("gid"), SAMPLE, size)).orderBy(F.xxhash64("gid"), "gid").limit(SAMPLE).select("vector").toArrow()
    flat = sample.column("vector").combine_chunks()
    x = lift(np.asarray(flat.values, dtype=np.float32).reshape(len(flat), -1), longest)
    centres = fit_centres(x, max(LEAF, -(-2 * len(x) // MOST_LISTS)))
    graph = neighbour_graph(centres)
    rows = f"gid long, vector {dict(index.dtypes)['vector']}, lists array<int>"

    posted = index.select("gid", "vector").mapInPandas(functools.partial(_assign, centres=centres, longest=longest, copies=COPIES, close=CLOSE), rows)
    posted = stage(posted, "posted")
    asked = vectors.where(queries).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("vector"))
    asked = asked.where(usable(F.col("vector"))).distinct().join(index.select("gid", "vector"), "vector").select("query_id", F.col("gid").alias("qid"))
    asked = stage(asked, "asked")
    wanted = index.join(asked.select(F.col("qid").alias("gid")).distinct(), "gid", "left_semi").select("gid", "vector")

    # one row for each list, at most twice MOST_LISTS or so
    sizes = np.zeros(len(centres), dtype=np.int64)
    for r in posted.select(F.explode("lists").alias("list")).groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    first, parts = (F.lit(x) for x in _buckets(sizes.tolist()))
    # a vector is in COPIES lists at most, so these hold k + 1 different ones
    probe = functools.partial(_probe, centres=centres, graph=graph, longest=longest, ratio=ratio, sizes=sizes, least=COPIES * (k + 1))
    probed = wanted.mapInPandas(probe, rows)

    def dealt(df: DataFrame, places, asks: bool) -> DataFrame:
        """Rows by bucket with their lists there; ``places`` gives the buckets of a list."""
        pairs = F.flatten(F.transform("lists", lambda l: F.transform(places(l), lambda b: F.struct(b.alias("b"), l.alias("l")))))
        df = df.select("gid", "vector", pairs.alias("pairs"))
        df = df.select("gid", "vector", "pairs", F.explode(F.array_distinct(F.col("pairs.b"))).alias("bucket"))
        own = F.transform(F.filter("pairs", lambda p: p["b"] == F.col("bucket")), lambda p: p["l"])
        return df.select("bucket", F.lit(asks).alias("asks"), "gid", "vector", own.alias("lists"))

    one = lambda l: F.array(F.get(first, l) + F.pmod(F.xxhash64("gid"), F.get(parts, l)).cast("int"))
    every = lambda l: F.sequence(F.get(first, l), F.get(first, l) + F.get(parts, l) - 1)
    both = dealt(posted, one, False).unionByName(dealt(probed, every, True)).repartition("bucket").sortWithinPartitions("bucket", "asks")
    found = both.mapInPandas(functools.partial(_stream, k=k), "qid long, gid long, score double")

    # a vector found in several buckets has one score but for rounding: the largest stands
    found = found.repartition("qid").groupBy("qid", "gid").agg(F.max("score").alias("score"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "gid")
    found = stage(found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth"), "found")
    copies = stage(index.where(F.size("ids") > 1).select("gid", "ids"), "copies")
    found = spread_join(found, sent_if_small(copies, 16 + 8 * F.size("ids")), "gid", "left")
    found = found.select("qid", "score", F.explode(F.coalesce("ids", F.array("gid"))).alias("vec_id"))
    # of equal vectors the smaller ids come first
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = spread_join(asked, stage(found, "nearest"), "qid").where("vec_id <> query_id").withColumn("rank", F.row_number().over(rank))
    return out.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Operators against small fixtures with known results."""

import random

import pytest
from pyspark.sql import functions as F

from keystrata.functions import bloom, folds, scalar
from keystrata.model import Bound, prefix_bounds
from keystrata.operators import gc, merge, snapshot, transactions, writes
from keystrata.plans import compaction, runs

LOG = "key string, ts long, is_delete boolean, value string"


def log(spark, rows):
    return spark.createDataFrame([(k, t, v is None, v) for k, t, v in rows], LOG)


def pairs(df):
    return [(r["key"], r["value"]) for r in df.collect()]


MVCC = [("a", 1, "1"), ("b", 2, "1"), ("a", 3, "2"), ("b", 4, None), ("c", 5, "1"), ("a", 6, "3"), ("b", 7, "3"), ("a", 8, "4"), ("b", 9, None), ("c", 10, "5")]


@pytest.mark.parametrize(
    "ts, want",
    [(2, "a1 b1"), (3, "a2 b1"), (5, "a2 c1"), (7, "a3 b3 c1"), (8, "a4 b3 c1"), (10, "a4 c5")],
)
def test_snapshots(spark, ts, want):
    assert " ".join(k + v for k, v in pairs(snapshot.scan(log(spark, MVCC), read_ts=ts))) == want


BOUNDS = [("0", 1, "2333333"), ("00", 1, "2333333"), ("4", 1, "23"), ("4", 2, None), ("1", 3, "233"), ("2", 3, "2333"), ("00", 3, "2333"), ("3", 4, "23333"), ("1", 4, None)]


@pytest.mark.parametrize(
    "lower, upper, want",
    [
        (Bound.unbounded(), Bound.unbounded(), ["0", "00", "2", "3"]),
        (Bound.incl("1"), Bound.incl("2"), ["2"]),
        (Bound.excl("1"), Bound.excl("3"), ["2"]),
        (Bound.incl("0"), Bound.incl("1"), ["0", "00"]),
        (Bound.excl("0"), Bound.incl("1"), ["00"]),
        (Bound.incl("5"), Bound.incl("8"), []),
    ],
)
def test_bounds(spark, lower, upper, want):
    assert [k for k, _ in pairs(snapshot.scan(log(spark, BOUNDS), lower, upper))] == want


def test_gets(spark):
    rows = log(spark, BOUNDS)
    assert pairs(snapshot.get(rows, "00")) == [("00", "2333")]
    assert pairs(snapshot.get(rows, "4")) == [] == pairs(snapshot.get(rows, "--"))
    keys = spark.createDataFrame([("0",), ("4",), ("555",)], "key string")
    assert sorted((r["key"], r["status"]) for r in snapshot.multi_get(rows, keys).collect()) == [("0", "found"), ("4", "deleted"), ("555", "missing")]


def test_prefixes():
    assert prefix_bounds(b"a\xff") == (Bound.incl(b"a\xff"), Bound.excl(b"b"))
    assert prefix_bounds(b"\xff")[1] == Bound.unbounded()
    assert prefix_bounds("")[0] == Bound.unbounded()
    with pytest.raises(ValueError):
        Bound("included")


def test_merges(spark):
    i1 = log(spark, [("a", 0, "1.1"), ("b", 0, "2.1"), ("c", 0, "3.1"), ("e", 0, None)])
    i2 = log(spark, [("a", 0, "1.2"), ("b", 0, "2.2"), ("c", 0, "3.2"), ("d", 0, "4.2")])
    i3 = log(spark, [("b", 0, "2.3"), ("c", 0, "3.3"), ("d", 0, "4.3")])
    empty = spark.createDataFrame([], LOG)
    assert pairs(merge.merge_k(i1, i2, i3)) == [("a", "1.1"), ("b", "2.1"), ("c", "3.1"), ("d", "4.2"), ("e", None)]
    assert pairs(merge.merge_k(i3, i1, i2)) == [("a", "1.1"), ("b", "2.3"), ("c", "3.3"), ("d", "4.3"), ("e", None)]
    assert pairs(merge.merge_two(i2, i1)) == [("a", "1.2"), ("b", "2.2"), ("c", "3.2"), ("d", "4.2"), ("e", None)]
    assert pairs(merge.merge_k(empty, empty)) == []


GC = [("a", 1, "1"), ("b", 1, "1"), ("a", 2, "2"), ("d", 2, "2"), ("a", 3, "3"), ("d", 3, None), ("c", 4, "4"), ("a", 4, None)]


@pytest.mark.parametrize(
    "mark, want",
    [(0, "a4 a3 a2 a1 b1 c4 d3 d2"), (1, "a4 a3 a2 a1 b1 c4 d3 d2"), (2, "a4 a3 a2 b1 c4 d3 d2"), (3, "a4 a3 b1 c4"), (4, "b1 c4")],
)
def test_collection(spark, mark, want):
    kept = gc.collect(log(spark, GC), mark, bottom=True).orderBy("key", F.desc("ts")).collect()
    assert " ".join(f"{r['key']}{r['ts']}" for r in kept) == want


def test_collection_with_filter(spark):
    rows = [(f"table{t}_{k}", ts, v) for t in (1, 2) for k, ts, v in (("a", 1, "1"), ("b", 1, "1"), ("c", 1, "1"), ("a", 2, "2"), ("b", 2, None), ("c", 2, "2"))]
    for mark, want in ((1, "table1_a:2 table1_a:1 table1_b:2 table1_b:1 table1_c:2 table1_c:1 table2_a:2 table2_b:2 table2_c:2"), (2, "table1_a:2 table1_c:2")):
        kept = gc.collect(log(spark, rows), mark, True, gc.prefix_filter("table2_")).orderBy("key", F.desc("ts")).collect()
        assert " ".join(f"{r['key']}:{r['ts']}" for r in kept) == want


def test_collection_keeps_snapshots(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abcde"), t, rng.choice([None, str(t)])) for t in range(1, 200)]
    for mark in (1, 50, 120, 199):
        kept = gc.collect(log(spark, rows), mark, bottom=True).cache()
        for ts in (mark, min(199, mark + 30), 199):
            assert pairs(snapshot.scan(kept, read_ts=ts)) == pairs(snapshot.scan(log(spark, rows), read_ts=ts))


def test_readers(spark):
    def state(changes):
        return tuple(transactions.low_watermark(spark.createDataFrame(changes, "read_ts long, delta int"), 7).first())

    changes = [(i, 1) for i in range(1001)]
    assert state(changes) == (0, 1001)
    changes += [(i, -1) for i in range(500)]
    assert state(changes) == (500, 501)
    changes += [(i, -1) for i in range(1000, 499, -1)]
    assert state(changes) == (7, 0)
    changes += [(2000, 1), (2000, 1), (2001, 1), (2000, -1)]
    assert state(changes) == (2000, 2)
    assert state([*changes, (2000, -1)]) == (2001, 1)


def test_batches(spark):
    ops = spark.createDataFrame([(1, 0, "put", "k", "1"), (1, 1, "del", "k", None), (2, 0, "put", "k", "2"), (2, 1, "put", "j", "")], "batch_no long, pos int, op string, key string, value string")
    got = sorted(tuple(r) for r in writes.apply_batches(ops, 10).collect())
    assert got == [("j", 12, True, None), ("k", 11, True, None), ("k", 12, False, "2")]
    with pytest.raises(ValueError):
        writes.put(b"", b"x")


def test_asof(spark):
    probes = spark.createDataFrame([(1, "a", 2), (2, "b", 4), (3, "zz", 9), (4, "a", 0), (5, "c", 10)], "probe_id long, key string, read_ts long")
    got = {r["probe_id"]: r["value"] for r in snapshot.asof_lookup(log(spark, MVCC), probes).collect()}
    assert got == {1: "1", 2: None, 3: None, 4: None, 5: "5"}


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.common_prefix_length(F.lit("key_010"), F.lit("key_0155")).alias("a"),
        scalar.common_prefix_length(F.lit(""), F.lit("x")).alias("b"),
        scalar.wrapping_add_u32(F.lit(4294967295), F.lit(2)).alias("c"),
        scalar.saturating_sub(F.lit(1), F.lit(5)).alias("d"),
        scalar.next_power_of_two(F.lit(1 << 40)).alias("e"),
        scalar.next_power_of_two(F.lit((1 << 40) + 1)).alias("f"),
        scalar.partition_point(F.array(*map(F.lit, (1, 2, 5))), lambda x: x < 3).alias("g"),
    ).first()
    assert tuple(row) == (6, 0, 1, 0, 1 << 40, 1 << 41, 2)
    assert scalar.crc32c(b"123456789") == 0xE3069283


def test_bloom(spark):
    assert bloom.bits_per_key(0.01) == 10
    keys = spark.range(1000).select("id", F.pmod(F.xxhash64("id"), F.lit(scalar.U32)).alias("hash32"))
    shape = bloom.Shape.of(100, 10)
    assert shape.probes == 6
    got = bloom.may_contain(keys, bloom.build(keys.where("id < 100"), shape), shape)
    rows = {r["id"]: r["maybe"] for r in got.collect()}
    assert all(rows[i] for i in range(100))
    assert 0 < sum(rows[i] for i in range(100, 1000)) < 100


def test_folds(spark):
    rows = spark.createDataFrame([(0, f"key_{i:03}", 1, "v" * 10) for i in range(100)], "run_id int, key string, ts long, value string")
    blocks = folds.pack_blocks(rows, 128).collect()
    assert len({r["block_no"] for r in blocks}) <= 34 and len(blocks) == 100
    one = spark.createDataFrame([(0, "k", t, "x" * 500) for t in range(1, 40)], "run_id int, key string, ts long, value string")
    assert {r["table_no"] for r in folds.split_tables(one, 128, 1000).collect()} == {0}  # one key stays in one table


RUNS = "run_id long, level int, prio long, first_key string, last_key string, max_ts long, entries long, bytes long"


def table(spark, rows):
    return spark.createDataFrame([(i, level, -i, a, b, 1, 1, size) for i, level, a, b, size in rows], RUNS)


def test_simple_plan(spark):
    plan = compaction.SimpleLeveled().plan
    assert plan(table(spark, [(1, 0, "a", "z", 1)])) is None
    assert plan(table(spark, [(1, 0, "a", "z", 1), (2, 0, "a", "z", 1)])) == compaction.Task(0, (2, 1), 1, (), False)
    deep = [(i, 3, "a", "b", 1) for i in (1, 2)] + [(3, 4, "c", "d", 1)]
    assert plan(table(spark, deep)) == compaction.Task(3, (2, 1), 4, (3,), True)


def test_leveled_plan(spark):
    s = compaction.Leveled(base_mb=128)
    flush = [(i, 0, "a", "f", 1) for i in range(1, 5)] + [(9, 4, "e", "k", 1), (10, 4, "l", "z", 1)]
    assert s.plan(table(spark, flush)) == compaction.Task(0, (4, 3, 2, 1), 4, (9,), True)
    assert s.targets({4: (1, 300 * compaction.MB)})[0] == {4: 300 * compaction.MB, 3: 150 * compaction.MB, 2: 75 * compaction.MB, 1: 0}
    assert s.targets({4: (1, 300 * compaction.MB)})[1] == 2
    full = [(1, 4, "a", "f", 300 * compaction.MB), (2, 3, "a", "c", 100 * compaction.MB), (3, 3, "d", "f", 100 * compaction.MB), (4, 4, "g", "z", 1)]
    assert s.plan(table(spark, full)) == compaction.Task(3, (2,), 4, (1,), True)


def test_leveled_pick_leaves_level_0(spark):
    s = compaction.Leveled(base_mb=128)
    flush = [(i, 0, "a", "f", 1) for i in range(10, 14)]
    full = [(1, 4, "a", "f", 300 * compaction.MB), (2, 3, "a", "c", 100 * compaction.MB), (3, 3, "d", "f", 100 * compaction.MB), (4, 4, "g", "z", 1)]
    assert s.plan(table(spark, flush + full)).upper_level == 0
    assert s.pick(table(spark, flush + full)) == compaction.Task(3, (2,), 4, (1,), True)
    assert s.pick(table(spark, flush)) is None


def test_tiered_plan(spark):
    tiers = lambda *files: table(spark, [(100 * t + i, t, "a", "z", 1) for t, n in enumerate(files) for i in range(n)])
    s = compaction.Tiered()
    assert s.plan(tiers(1, 1)) is None
    assert s.plan(tiers(1, 1, 1)).bottom
    picked = s.plan(tiers(2, 1, 9))
    assert (picked.lower_level, picked.bottom, len(picked.upper)) == (1, False, 3)
    reduced = compaction.Tiered(size_ratio=1000).plan(tiers(1, 1, 9))
    assert (reduced.lower_level, reduced.bottom) == (1, False)


def test_run_pruning(spark):
    meta = table(spark, [(1, 0, "b", "d", 1), (2, 0, "e", "g", 1)])
    ids = lambda c: sorted(r["run_id"] for r in meta.where(c).collect())
    assert ids(runs.overlaps(Bound.excl("d"), Bound.excl("e"))) == []
    assert ids(runs.overlaps(Bound.incl("d"), Bound.incl("e"))) == [1, 2]
    assert ids(runs.holds("f")) == [2] and ids(runs.holds("a")) == []

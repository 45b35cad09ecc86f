"""The engine's operators as queries on the driver's tables, each with the same query in SQL.

The log of versions is derived from ``events`` (``model.event_log``). Read timestamps and watermarks are half of the
latest commit, so that every query works at any scale.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bloom, folds, scalar
from .model import EVENT_LOG_SQL, UNBOUNDED, Bound, event_log, user_key
from .operators import gc, merge, snapshot, transactions, writes
from .plans import compaction, runs
from .sources.store import Run, replay

Query = Callable[[SparkSession, str], DataFrame]
KV = f"kv AS ({EVENT_LOG_SQL})"
HALF = "(SELECT max(ts) // 2 FROM kv)"
LATEST = f"""n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC) AS nth FROM kv WHERE ts <= {HALF})"""
LIVE = f"WITH {KV}, {LATEST} SELECT key, value FROM n WHERE nth = 1 AND NOT is_delete"

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f: Query) -> Query:
        _queries[name], _sql[name] = f, sql
        return f

    return add


def half(log: DataFrame) -> Column:
    return log.select(F.expr("max(ts) DIV 2")).scalar()


def user(n: Column) -> Column:
    return user_key(n)


def ranged(log: DataFrame) -> DataFrame:
    """The log in runs of ten users each, whose key ranges do not meet."""
    return log.withColumn("run_id", F.expr("CAST(CAST(substr(key, 2) AS INT) DIV 10 AS INT)"))


RANGED = "rg AS (SELECT key, ts, is_delete, value, CAST(CAST(substr(key, 2) AS INTEGER) // 10 AS INTEGER) AS run_id FROM kv)"
STATS = "SELECT run_id, min(key) AS first_key, max(key) AS last_key, max(ts) AS max_ts, count(*) AS entries, CAST(sum(length(key) + 8 + length(value)) AS BIGINT) AS bytes FROM {0} GROUP BY run_id"


# reads


@query("snapshot_at_ts", LIVE)
def snapshot_at_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return snapshot.scan(log, read_ts=half(log))


@query("snapshot_latest", LIVE.replace(f"WHERE ts <= {HALF}", ""))
def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.scan(event_log(spark, sf_dir))


@query("point_get_latest", LIVE.replace(f"WHERE ts <= {HALF}", "") + " AND key = 'u00007'")
def point_get_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.get(event_log(spark, sf_dir), "u00007")


@query("point_get_at_ts", LIVE + " AND key = 'u00008'")
def point_get_at_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return snapshot.get(log, "u00008", half(log))


@query(
    "multi_get_status",
    f"""WITH {KV}, {LATEST}, p AS (SELECT concat('u', lpad(CAST(i * 10 AS VARCHAR), 5, '0')) AS key FROM range(40) AS t(i))
    SELECT p.key, CASE WHEN n.key IS NULL THEN 'missing' WHEN is_delete THEN 'deleted' ELSE 'found' END AS status,
      CASE WHEN NOT is_delete THEN value END AS value FROM p LEFT JOIN (SELECT * FROM n WHERE nth = 1) n ON n.key = p.key""",
)
def multi_get_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return snapshot.multi_get(log, spark.range(40).select(user(F.col("id") * 10).alias("key")), half(log))


_BOUNDS = {
    "scan_ii": (Bound.incl("u00010"), Bound.incl("u00050"), "key >= 'u00010' AND key <= 'u00050'"),
    "scan_ee": (Bound.excl("u00010"), Bound.excl("u00050"), "key > 'u00010' AND key < 'u00050'"),
    "scan_ie": (Bound.incl("u00010"), Bound.excl("u00050"), "key >= 'u00010' AND key < 'u00050'"),
    "scan_ei": (Bound.excl("u00010"), Bound.incl("u00050"), "key > 'u00010' AND key <= 'u00050'"),
    "scan_unb_incl": (UNBOUNDED, Bound.incl("u00050"), "key <= 'u00050'"),
    "scan_incl_unb": (Bound.incl("u00010"), UNBOUNDED, "key >= 'u00010'"),
}


def _bounded(lower: Bound, upper: Bound) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = event_log(spark, sf_dir)
        return snapshot.scan(log, lower, upper, half(log))

    return run


for _name, (_lower, _upper, _where) in _BOUNDS.items():
    query(_name, f"{LIVE} AND {_where}")(_bounded(_lower, _upper))


@query("prefix_scan", LIVE + " AND starts_with(key, 'u0001')")
def prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return snapshot.prefix_scan(log, "u0001", half(log))


@query("all_versions", f"WITH {KV} SELECT key, ts, is_delete, value FROM kv WHERE key >= 'u00020' AND key <= 'u00080'")
def all_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.all_versions(event_log(spark, sf_dir), Bound.incl("u00020"), Bound.incl("u00080"))


@query("tombstones_visible", f"WITH {KV}, {LATEST} SELECT key, ts FROM n WHERE nth = 1 AND is_delete")
def tombstones_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return snapshot.hidden(log, half(log))


@query(
    "asof_lookup",
    f"""WITH {KV}, p AS (SELECT o_orderkey AS probe_id, concat('u', lpad(CAST(o_custkey % 200 AS VARCHAR), 5, '0')) AS key,
      o_orderkey % (SELECT max(ts) FROM kv) + 1 AS read_ts FROM orders)
    SELECT p.probe_id, p.key, p.read_ts, CASE WHEN NOT kv.is_delete THEN kv.value END AS value
    FROM p ASOF LEFT JOIN kv ON p.key = kv.key AND p.read_ts >= kv.ts""",
)
def asof_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    last = log.select(F.max("ts")).scalar()
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    probes = orders.select(F.col("o_orderkey").alias("probe_id"), user(F.col("o_custkey") % 200).alias("key"), (F.col("o_orderkey") % last + 1).alias("read_ts"))
    return snapshot.asof_lookup(log, probes)


# merges

_MERGED = """SELECT key, ts, is_delete, value FROM (SELECT *, row_number() OVER (PARTITION BY key, ts ORDER BY prio) AS nth FROM ({0})) WHERE nth = 1"""


def _tagged(log: DataFrame, tag: str) -> DataFrame:
    return log.withColumn("value", F.when(F.col("is_delete"), "").otherwise(F.concat(F.lit(tag), F.col("value"))))


def _tagged_sql(tag: str, prio: int, where: str) -> str:
    return f"SELECT key, ts, is_delete, CASE WHEN is_delete THEN '' ELSE concat('{tag}', value) END AS value, {prio} AS prio FROM kv WHERE {where}"


@query(
    "merge_k_priority",
    f"WITH {KV} " + _MERGED.format(" UNION ALL ".join([_tagged_sql("a:", 0, "ts % 3 = 0"), _tagged_sql("b:", 1, "ts % 2 = 0"), _tagged_sql("c:", 2, "true")])),
)
def merge_k_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return merge.merge_k(_tagged(log.where("ts % 3 = 0"), "a:"), _tagged(log.where("ts % 2 = 0"), "b:"), _tagged(log, "c:"))


@query("merge_two", f"WITH {KV} " + _MERGED.format(" UNION ALL ".join([_tagged_sql("a:", 0, "ts % 3 = 0"), _tagged_sql("b:", 1, "ts % 5 <> 0")])))
def merge_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return merge.merge_two(_tagged(log.where("ts % 3 = 0"), "a:"), _tagged(log.where("ts % 5 <> 0"), "b:"))


@query("concat_runs", f"WITH {KV} SELECT key, ts, is_delete, value FROM kv")
def concat_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return merge.concat(log.where("key < 'u00030'"), log.where("key >= 'u00030' AND key < 'u00090'"), log.where("key >= 'u00090'"))


@query(
    "concat_validate",
    f"""WITH {KV}, s AS ({STATS.format("kv")}), w AS (SELECT *, lead(run_id) OVER (ORDER BY first_key, run_id) AS next_id,
      lead(first_key) OVER (ORDER BY first_key, run_id) AS next_first FROM s)
    SELECT run_id, last_key, next_id, next_first FROM w WHERE first_key > last_key OR next_first <= last_key""",
)
def concat_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.concat_violations(runs.run_stats(event_log(spark, sf_dir)))


# writes, transactions, readers


@query(
    "batch_last_write_wins",
    f"""WITH {KV}, o AS (SELECT key, (ts - 1) // 25 + 1 AS batch_no, (ts - 1) % 25 AS pos, is_delete, value FROM kv),
    w AS (SELECT *, row_number() OVER (PARTITION BY batch_no, key ORDER BY pos DESC) AS nth FROM o)
    SELECT key, 100 + batch_no AS ts, is_delete, CASE WHEN NOT is_delete THEN value END AS value FROM w WHERE nth = 1""",
)
def batch_last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("is_delete"), "del").otherwise("put")
    ops = event_log(spark, sf_dir).select("key", F.expr("(ts - 1) DIV 25 + 1").alias("batch_no"), F.expr("(ts - 1) % 25").alias("pos"), op.alias("op"), "value")
    return writes.apply_batches(ops, 100)


def _overlay_sql(overlay: str) -> str:
    return f"""WITH {KV}, {LATEST}, o AS ({overlay}) SELECT key, value FROM o WHERE NOT is_delete
    UNION ALL SELECT key, value FROM n WHERE nth = 1 AND NOT is_delete AND key NOT IN (SELECT key FROM o)"""


@query(
    "txn_overlay_scan",
    _overlay_sql("SELECT concat('u', lpad(n, CAST(greatest(5, length(n)) AS INTEGER), '0')) AS key, c_custkey % 2 = 0 AS is_delete, concat('local@', CAST(c_custkey AS VARCHAR)) AS value FROM (SELECT *, CAST(c_custkey * 3 AS VARCHAR) AS n FROM customer)"),
)
def txn_overlay_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    own = customer.select(user(F.col("c_custkey") * 3).alias("key"), (F.col("c_custkey") % 2 == 0).alias("is_delete"), F.concat(F.lit("local@"), F.col("c_custkey").cast("string")).alias("value"))
    return transactions.overlay_scan(log, own, half(log))


@query("txn_overlay_delete", _overlay_sql("SELECT concat('u', lpad(CAST(i * 5 AS VARCHAR), 5, '0')) AS key, true AS is_delete, '' AS value FROM range(30) AS t(i)"))
def txn_overlay_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    own = spark.range(30).select(user(F.col("id") * 5).alias("key"), F.lit(True).alias("is_delete"), F.lit("").alias("value"))
    return transactions.overlay_scan(log, own, half(log))


_OCC = f"""WITH {KV}, reads AS (SELECT ts // 20 AS txn, key, ts // 20 * 20 AS read_ts FROM kv WHERE ts % 2 = 0 AND (ts // 20) % 3 <> 0),
  writes AS (SELECT DISTINCT ts // 20 AS txn FROM kv WHERE ts % 2 = 1 AND (ts // 20) % 2 = 0),
  txns AS (SELECT DISTINCT ts // 20 AS txn, ts // 20 * 20 AS read_ts FROM kv),
  commits AS (SELECT ts AS commit_ts, key FROM kv WHERE ts % 7 = 0 AND ts <= {HALF}),
  bad AS (SELECT DISTINCT r.txn, r.key FROM reads r JOIN commits c ON c.key = r.key AND c.commit_ts > r.read_ts)"""
_OUTCOME = "SELECT txn, CASE WHEN txn IN (SELECT txn FROM bad) AND txn IN (SELECT txn FROM writes) THEN 'aborted' ELSE 'committed' END AS outcome FROM txns"


def _occ(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    log = event_log(spark, sf_dir).withColumn("txn", F.expr("ts DIV 20"))
    txns = log.select("txn", (F.col("txn") * 20).alias("read_ts")).distinct()
    reads = log.where("ts % 2 = 0 AND txn % 3 <> 0").select("txn", "key")
    writers = log.where("ts % 2 = 1 AND txn % 2 = 0").select("txn", "key")
    commits = log.where((F.col("ts") % 7 == 0) & (F.col("ts") <= half(log))).select(F.col("ts").alias("commit_ts"), "key")
    return txns, reads, writers, commits


@query("occ_conflicts", f"{_OCC} SELECT txn, key FROM bad")
def occ_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    txns, reads, _, commits = _occ(spark, sf_dir)
    return transactions.conflicts(reads.join(txns, "txn"), commits)


@query("occ_decide", f"{_OCC} {_OUTCOME}")
def occ_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.decide(*_occ(spark, sf_dir))


@query("occ_blind_writes", f"{_OCC} {_OUTCOME} WHERE txn % 3 = 0")
def occ_blind_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    txns, reads, writers, commits = _occ(spark, sf_dir)
    return transactions.decide(txns.where("txn % 3 = 0"), reads, writers, commits)


@query("occ_read_only", f"{_OCC} {_OUTCOME} WHERE txn % 2 = 1")
def occ_read_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    txns, reads, writers, commits = _occ(spark, sf_dir)
    return transactions.decide(txns.where("txn % 2 = 1"), reads, writers, commits)


@query("committed_prune", f"WITH {KV} SELECT ts AS commit_ts, key FROM kv WHERE ts >= {HALF}")
def committed_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return transactions.prune_commits(log.select(F.col("ts").alias("commit_ts"), "key"), half(log))


_READERS = """c AS (SELECT event_id // 4 AS read_ts, 1 AS delta FROM events
  UNION ALL SELECT event_id // 4, -1 FROM events WHERE (event_id // 4) % 5 <> 3)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr("event_id DIV 4").alias("read_ts"))
    return events.withColumn("delta", F.lit(1)).unionByName(events.where("read_ts % 5 <> 3").withColumn("delta", F.lit(-1)))


@query("reader_watermark", f"WITH {_READERS}, l AS (SELECT read_ts FROM c GROUP BY read_ts HAVING sum(delta) > 0) SELECT coalesce(min(read_ts), 0) AS low_watermark, count(*) AS retained FROM l")
def reader_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.low_watermark(_changes(spark, sf_dir), 0)


@query("retained_snapshots", f"WITH {_READERS} SELECT read_ts, CAST(sum(delta) AS BIGINT) AS readers FROM c GROUP BY read_ts HAVING sum(delta) > 0")
def retained_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.live_readers(_changes(spark, sf_dir))


# garbage collection

_GC = f"""w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC) AS nth, sum(CASE WHEN ts <= {HALF} THEN 1 ELSE 0 END)
  OVER (PARTITION BY key ORDER BY ts DESC ROWS UNBOUNDED PRECEDING) AS below FROM kv)"""


def _gc_sql(extra: str = "") -> str:
    return f"WITH {KV}, {_GC} SELECT key, ts, is_delete, value FROM w WHERE ts > {HALF} OR (below = 1 {extra})"


def _versions(log: DataFrame) -> DataFrame:
    return log.select(*merge.COLUMNS)


@query("gc_keep", _gc_sql())
def gc_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return gc.collect(_versions(log), half(log))


@query("gc_bottom", _gc_sql("AND NOT (is_delete AND nth = 1)"))
def gc_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return gc.collect(_versions(log), half(log), bottom=True)


@query("gc_prefix_filter", _gc_sql("AND NOT starts_with(key, 'u0001') AND NOT (is_delete AND nth = 1)"))
def gc_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return gc.collect(_versions(log), half(log), bottom=True, dropped=gc.prefix_filter("u0001"))


@query("gc_snapshot_invariant", "SELECT CAST(0 AS BIGINT) AS differences")
def gc_snapshot_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    kept = gc.collect(_versions(log), half(log), bottom=True)
    total = None
    for share in ("DIV 2", "* 3 DIV 4", "* 1"):
        at = log.select(F.expr(f"max(ts) {share}")).scalar()
        before, after = snapshot.scan(log, read_ts=at, ordered=False), snapshot.scan(kept, read_ts=at, ordered=False)
        different = before.exceptAll(after).unionByName(after.exceptAll(before))
        total = different if total is None else total.unionByName(different)
    return total.agg(F.count(F.lit(1)).alias("differences"))


# runs and plans


@query("run_stats", f"WITH {KV} {STATS.format('kv')}")
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_stats(event_log(spark, sf_dir))


@query("scan_run_pruning", f"WITH {KV}, {RANGED}, s AS ({STATS.format('rg')}) SELECT run_id, first_key, last_key FROM s WHERE last_key >= 'u00025' AND first_key < 'u00050'")
def scan_run_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = runs.run_stats(ranged(event_log(spark, sf_dir)))
    return stats.where(runs.overlaps(Bound.incl("u00025"), Bound.excl("u00050"))).select("run_id", "first_key", "last_key")


@query("get_run_pruning", f"WITH {KV}, {RANGED}, s AS ({STATS.format('rg')}) SELECT run_id, first_key, last_key FROM s WHERE 'u00042' BETWEEN first_key AND last_key")
def get_run_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_stats(ranged(event_log(spark, sf_dir))).where(runs.holds("u00042")).select("run_id", "first_key", "last_key")


@query(
    "active_sources",
    f"""WITH {KV}, {RANGED}, s AS ({STATS.format('rg')}), r AS (SELECT i AS range_no, concat('u', lpad(CAST(i * 15 AS VARCHAR), 5, '0')) AS lo,
      concat('u', lpad(CAST(i * 15 + 20 AS VARCHAR), 5, '0')) AS hi FROM range(8) AS t(i))
    SELECT range_no, count(s.run_id) AS active FROM r LEFT JOIN s ON s.last_key >= r.lo AND s.first_key <= r.hi GROUP BY range_no""",
)
def active_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = runs.run_stats(ranged(event_log(spark, sf_dir)))
    ranges = spark.range(8).select(F.col("id").alias("range_no"), user(F.col("id") * 15).alias("lo"), user(F.col("id") * 15 + 20).alias("hi"))
    met = F.broadcast(ranges).join(stats, (F.col("last_key") >= F.col("lo")) & (F.col("first_key") <= F.col("hi")), "left")
    return met.groupBy("range_no").agg(F.count("run_id").alias("active"))


@query(
    "overlapping_runs",
    f"WITH {KV}, s AS ({STATS.format('kv')}) SELECT a.run_id, b.run_id AS other_id FROM s a JOIN s b ON a.run_id < b.run_id AND a.first_key <= b.last_key AND b.first_key <= a.last_key",
)
def overlapping_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.overlapping_pairs(runs.run_stats(event_log(spark, sf_dir)))


_LEVELS = f"{KV}, {RANGED}, s AS ({STATS.format('rg')}), lv AS (SELECT CAST(run_id AS BIGINT) AS run_id, CAST(run_id % {{0}} AS INTEGER) AS level, first_key, last_key, max_ts, entries, bytes * 1000 AS bytes FROM s)"


def _levelled(spark: SparkSession, sf_dir: str, levels: int) -> DataFrame:
    """The ranged runs dealt over levels, a thousand times as large as they are."""
    stats = runs.run_stats(ranged(event_log(spark, sf_dir)))
    return stats.select(
        F.col("run_id").cast("long").alias("run_id"), (F.col("run_id") % levels).alias("level"), (-F.col("run_id")).cast("long").alias("prio"), "first_key", "last_key", "max_ts", "entries", (F.col("bytes") * 1000).alias("bytes")
    )


def _task_rows(spark: SparkSession, task: compaction.Task | None) -> DataFrame:
    rows = [] if task is None else [(i, task.upper_level, task.lower_level, "upper", task.bottom) for i in task.upper] + [(i, task.upper_level, task.lower_level, "lower", task.bottom) for i in task.lower]
    return spark.createDataFrame(rows, "run_id long, upper_level int, lower_level int, side string, bottom boolean")


@query("level_summary", f"WITH {_LEVELS.format(4)} SELECT level, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(entries) AS BIGINT) AS entries FROM lv GROUP BY level")
def level_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.level_summary(_levelled(spark, sf_dir, 4))


@query(
    "plan_simple",
    f"""WITH {_LEVELS.format(3)}, f AS (SELECT CAST(l AS INTEGER) AS l, (SELECT count(*) FROM lv WHERE level = l) AS n FROM range(5) AS t(l)),
    p AS (SELECT min(a.l) AS up FROM f a JOIN f b ON b.l = a.l + 1 WHERE a.l < 4 AND a.n > 0 AND (a.l > 0 OR a.n >= 2) AND b.n * 100 < 200 * a.n)
    SELECT run_id, up AS upper_level, up + 1 AS lower_level, CASE WHEN level = up THEN 'upper' ELSE 'lower' END AS side, up + 1 = 4 AS bottom
    FROM lv, p WHERE level = up OR level = up + 1""",
)
def plan_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _task_rows(spark, compaction.SimpleLeveled().plan(_levelled(spark, sf_dir, 3)))


_TARGETS = """b AS (SELECT CAST(l AS INTEGER) AS l, coalesce((SELECT sum(bytes) FROM lv WHERE level = l), 0) AS real FROM range(1, 5) AS t(l)),
  t4 AS (SELECT greatest((SELECT real FROM b WHERE l = 4), 1048576) AS t), t3 AS (SELECT CASE WHEN t > 1048576 THEN t // 2 ELSE 0 END AS t FROM t4),
  t2 AS (SELECT CASE WHEN t > 1048576 THEN t // 2 ELSE 0 END AS t FROM t3), t1 AS (SELECT CASE WHEN t > 1048576 THEN t // 2 ELSE 0 END AS t FROM t2),
  tg AS (SELECT 1 AS l, t FROM t1 UNION ALL SELECT 2, t FROM t2 UNION ALL SELECT 3, t FROM t3 UNION ALL SELECT 4, t FROM t4)"""


@query("plan_leveled_targets", f"WITH {_LEVELS.format(5)}, {_TARGETS} SELECT CAST(l AS INTEGER) AS level, CAST(t AS BIGINT) AS target FROM tg")
def plan_leveled_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, _ = compaction.Leveled(base_mb=1).targets(compaction.level_sizes(_levelled(spark, sf_dir, 5)))
    return spark.createDataFrame(sorted(target.items()), "level int, target long")


@query(
    "plan_leveled_pick",
    f"""WITH {_LEVELS.format(5)}, {_TARGETS}, fl AS (SELECT b.l, real / t AS r FROM b JOIN tg ON b.l = tg.l WHERE b.l < 4 AND real > t),
    u AS (SELECT l AS up FROM fl ORDER BY r DESC, l LIMIT 1), o AS (SELECT min(run_id) AS pick FROM lv, u WHERE level = up),
    k AS (SELECT first_key AS lo, last_key AS hi FROM lv, o WHERE run_id = pick)
    SELECT run_id, CAST(up AS INTEGER) AS upper_level, CAST(up + 1 AS INTEGER) AS lower_level, CASE WHEN level = up THEN 'upper' ELSE 'lower' END AS side, up + 1 = 4 AS bottom
    FROM lv, u, o, k WHERE run_id = pick OR (level = up + 1 AND last_key >= lo AND first_key <= hi)""",
)
def plan_leveled_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _task_rows(spark, compaction.Leveled(base_mb=1, l0_trigger=1000).pick(_levelled(spark, sf_dir, 5)))


@query(
    "plan_tiered",
    f"""WITH {_LEVELS.format(4)}, f AS (SELECT level, count(*) AS n, row_number() OVER (ORDER BY level) AS i, count(*) OVER () AS tiers FROM lv GROUP BY level),
    c AS (SELECT *, sum(n) OVER (ORDER BY i) AS cum, lead(n) OVER (ORDER BY i) AS nxt FROM f),
    w AS (SELECT CASE WHEN max(tiers) < 3 THEN 0
      WHEN (SELECT sum(n) * 100 FROM c WHERE i < tiers) >= 400 * (SELECT n FROM c WHERE i = tiers) THEN max(tiers)
      ELSE coalesce((SELECT min(i) + 1 FROM c WHERE cum * 100 >= 101 * nxt AND i + 1 >= 2), least(max(tiers) - 3 + 2, max(tiers))) END AS take FROM c)
    SELECT run_id, CAST((SELECT min(level) FROM f) AS INTEGER) AS upper_level, CAST((SELECT level FROM f, w WHERE i = take) AS INTEGER) AS lower_level, 'upper' AS side, take >= tiers AS bottom
    FROM lv JOIN f USING (level), w WHERE i <= take""",
)
def plan_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _task_rows(spark, compaction.Tiered(max_amplification_percent=400).plan(_levelled(spark, sf_dir, 4)))


# sizes, folds, filters


@query(
    "memtable_running_size",
    f"WITH {KV} SELECT run_id, ts, CAST(sum(length(key) + 8 + length(value)) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bytes FROM kv",
)
def memtable_running_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("run_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return event_log(spark, sf_dir).select("run_id", "ts", F.sum(scalar.entry_size("key", "value")).over(order).alias("bytes"))


@query(
    "freeze_points",
    f"""WITH RECURSIVE {KV}, e AS (SELECT run_id, ts, length(key) + 8 + length(value) AS size, row_number() OVER (PARTITION BY run_id ORDER BY ts) AS i FROM kv),
    f AS (SELECT run_id, i, ts, size AS acc, 0 AS no FROM e WHERE i = 1
      UNION ALL SELECT e.run_id, e.i, e.ts, CASE WHEN f.acc >= 1024 THEN e.size ELSE f.acc + e.size END, CASE WHEN f.acc >= 1024 THEN f.no + 1 ELSE f.no END
      FROM f JOIN e ON e.run_id = f.run_id AND e.i = f.i + 1)
    SELECT run_id, CAST(no AS BIGINT) AS buffer_no, ts, CAST(acc AS BIGINT) AS bytes FROM f WHERE acc >= 1024""",
)
def freeze_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.freeze_points(event_log(spark, sf_dir), 1024)


_SHARED = "len(list_filter(range(1, least(length({0}), length({1})) + 1), lambda n: substr({0}, 1, n) = substr({1}, 1, n)))"
_ENTRIES = "e AS (SELECT run_id, ts, key, length(key) AS k, length(value) AS v, row_number() OVER (PARTITION BY run_id ORDER BY key, ts DESC) AS i FROM kv)"
# data: bytes of the block's entries, n: their number; an entry costs 14 bytes, its rest of the key and its value
_FITS = "(2 + f.data + 2 * f.n + e.k + 8 + e.v + 6 <= 512)"


@query(
    "block_packing",
    f"""WITH RECURSIVE {KV}, {_ENTRIES},
    f AS (SELECT run_id, i, ts, key, key AS first, 14 + k + v AS data, 1 AS n, 0 AS block FROM e WHERE i = 1
      UNION ALL SELECT e.run_id, e.i, e.ts, e.key, CASE WHEN {_FITS} THEN f.first ELSE e.key END,
        CASE WHEN {_FITS} THEN f.data + 14 + e.k + e.v - {_SHARED.format("f.first", "e.key")} ELSE 14 + e.k + e.v END,
        CASE WHEN {_FITS} THEN f.n + 1 ELSE 1 END, CASE WHEN {_FITS} THEN f.block ELSE f.block + 1 END
      FROM f JOIN e ON e.run_id = f.run_id AND e.i = f.i + 1)
    SELECT run_id, CAST(block AS BIGINT) AS block_no, key, ts FROM f""",
)
def block_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.pack_blocks(event_log(spark, sf_dir), 512)


@query(
    "sst_split",
    f"""WITH RECURSIVE {KV}, {_ENTRIES},
    f AS (SELECT run_id, i, ts, key, key AS first, 14 + k + v AS data, 1 AS n, 0 AS block, 0 AS done, 0 AS tab FROM e WHERE i = 1
      UNION ALL SELECT run_id, i, ts, key, CASE WHEN kind = 0 THEN first ELSE key END, CASE WHEN kind = 0 THEN data + 14 + k + v - shared ELSE 14 + k + v END,
        CASE WHEN kind = 0 THEN n + 1 ELSE 1 END, CASE kind WHEN 0 THEN block WHEN 1 THEN block + 1 ELSE 0 END,
        CASE kind WHEN 0 THEN done WHEN 1 THEN done + 2 + data + 2 * n + 4 ELSE 0 END, CASE WHEN kind = 2 THEN tab + 1 ELSE tab END
      FROM (SELECT e.run_id, e.i, e.ts, e.key, e.k, e.v, f.first, f.data, f.n, f.block, f.done, f.tab, {_SHARED.format("f.first", "e.key")} AS shared,
          CASE WHEN f.done >= 4096 AND e.key <> f.key THEN 2 WHEN {_FITS} THEN 0 ELSE 1 END AS kind
        FROM f JOIN e ON e.run_id = f.run_id AND e.i = f.i + 1))
    SELECT run_id, CAST(tab AS BIGINT) AS table_no, CAST(block AS BIGINT) AS block_no, key, ts FROM f""",
)
def sst_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.split_tables(event_log(spark, sf_dir), 512, 4096)


@query(
    "lcp_with_block_first",
    f"WITH {KV}, m AS (SELECT run_id, min(key) AS first FROM kv GROUP BY run_id), d AS (SELECT DISTINCT run_id, key FROM kv) SELECT run_id, key, CAST({_SHARED.format('first', 'key')} AS BIGINT) AS shared FROM d JOIN m USING (run_id)",
)
def lcp_with_block_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    first = log.groupBy("run_id").agg(F.min("key").alias("first"))
    return log.select("run_id", "key").distinct().join(first, "run_id").select("run_id", "key", scalar.common_prefix_length(F.col("first"), F.col("key")).alias("shared"))


@query(
    "scalar_functions",
    f"""SELECT event_id, CAST(CASE WHEN event_id <= 1 THEN 1 ELSE 2 ** ceil(log2(event_id)) END AS BIGINT) AS power, (event_id * 2654435761 % 4294967296 + 4294960000) % 4294967296 AS wrapped,
      greatest(event_id - 500, 0) AS saturated, CAST(length(event_type) + 8 AS BIGINT) AS raw_size FROM events""",
)
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id")
    return events.select(
        "event_id",
        scalar.next_power_of_two(n).alias("power"),
        scalar.wrapping_add_u32(n * 2654435761 % scalar.U32, F.lit(4294960000)).alias("wrapped"),
        scalar.saturating_sub(n, F.lit(500)).cast("long").alias("saturated"),
        scalar.raw_key_size("event_type").alias("raw_size"),
    )


@query("bloom_sizing", "SELECT i AS exponent, CAST(ceil(-ln(power(0.1, i)) / power(ln(2), 2)) AS BIGINT) AS bits_per_key FROM range(1, 6) AS t(i)")
def bloom_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, bloom.bits_per_key(0.1**i)) for i in range(1, 6)], "exponent long, bits_per_key long")


_HASH = "user_id * 2654435761 % 4294967296"
_PROBES = "unnest(list_transform(range(6), lambda i: ((h + i * ((h >> 17) | ((h * 32768) % 4294967296))) % 4294967296) % 1000))"


@query(
    "bloom_probe",
    f"""WITH u AS (SELECT DISTINCT user_id, {_HASH} AS h FROM events), bits AS (SELECT DISTINCT {_PROBES} AS bit FROM u WHERE user_id % 2 = 0),
    p AS (SELECT user_id, h, {_PROBES} AS bit FROM u)
    SELECT user_id, h AS hash32, bool_and(bit IN (SELECT bit FROM bits)) AS maybe FROM p GROUP BY user_id, h""",
)
def bloom_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", (F.col("user_id") * 2654435761 % scalar.U32).alias("hash32")).distinct()
    shape = bloom.Shape.of(100, 10)
    return bloom.may_contain(users, bloom.build(users.where("user_id % 2 = 0"), shape), shape)


# recovery


@query(
    "manifest_replay",
    """WITH added AS (SELECT i AS seq, i AS run_id FROM range(1, 201) AS t(i)), removed AS (SELECT i + 1 AS seq, j AS run_id FROM range(1, 201) AS t(i), range(1, 201) AS s(j) WHERE i % 10 = 0 AND j <= i AND j % 7 <> 0),
    e AS (SELECT run_id, seq, 0 AS gone FROM added UNION ALL SELECT run_id, seq, 1 FROM removed)
    SELECT run_id, max(seq) AS seq FROM e GROUP BY run_id HAVING max(gone) = 0""",
)
def manifest_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of 200 flushes, and after every tenth a merge that removes most of the runs before it, replayed by
    the store's own recovery."""
    records = []
    for i in range(1, 201):
        run = Run(i, 0, b"a", b"z", i, 1, 1, f"runs/{i}")
        records.append({"type": "flush", "flushed": i, "added": [run.as_json()]})
        if i % 10 == 0:
            records.append({"type": "compaction", "removed": [j for j in range(1, i + 1) if j % 7]})
    live, _, _ = replay(records)
    return spark.createDataFrame([(r.run_id, r.max_ts) for r in live], "run_id long, seq long")


@query(
    "wal_replay",
    f"""WITH {KV}, flushed AS (SELECT max(ts) AS ts FROM kv WHERE run_id < (SELECT max(run_id) FROM kv)), b AS (SELECT kv.* FROM kv, flushed WHERE kv.ts > coalesce(flushed.ts, 0))
    SELECT key, max(ts) AS ts, count(*) AS versions, (SELECT max(ts) FROM kv) AS recovered_ts FROM b GROUP BY key""",
)
def wal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    last_run = log.select(F.max("run_id")).scalar()
    flushed = log.where(F.col("run_id") < last_run).select(F.coalesce(F.max("ts"), F.lit(0))).scalar()
    pending = log.where(F.col("ts") > flushed)
    return pending.groupBy("key").agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("versions")).withColumn("recovered_ts", log.select(F.max("ts")).scalar())


@query(
    "fill_epochs",
    """WITH w AS (SELECT r * 5000 + i AS n, r FROM range(10) AS a(r), range(10000) AS b(i))
    SELECT lpad(CAST(n AS VARCHAR), 10, ' ') AS key, count(*) AS versions, concat('value', CAST(n AS VARCHAR), '@', CAST(max(r) AS VARCHAR)) AS value FROM w GROUP BY n""",
)
def fill_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    puts = spark.range(100_000).select(F.expr("id DIV 10000 * 5000 + id % 10000").alias("n"), F.expr("id DIV 10000").alias("round"))
    last = puts.groupBy("n").agg(F.count(F.lit(1)).alias("versions"), F.max("round").alias("round"))
    n = F.col("n").cast("string")
    return last.select(F.lpad(n, 10, " ").alias("key"), "versions", F.concat(F.lit("value"), n, F.lit("@"), F.col("round").cast("string")).alias("value"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)

"""Helpers that the training-data operators share: shipping code, staging tables, connected components."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import functools
import gc
import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shipping

__all__ = ["SPACE", "WORD", "connected_components", "crc_mod", "crc_mod_py", "drawn", "fresh", "local", "only", "passing", "read", "sent_if_small", "shared_dir", "ship", "spread_join", "stage", "tidy", "unstage"]

#: ASCII white space; words are the maximal runs of other characters.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: Rows and bytes of a batch that a Python worker gets at once.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20

_caches: list[dict] = []


def ship(spark: SparkSession) -> None:
    """Make this package importable in tasks, and the batches that Python workers get small."""
    shipping.ship(spark)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        if now is None or not 0 < _bytes(now) <= most:
            spark.conf.set(key, str(most))


def _bytes(value: str) -> int:
    """A number with an optional unit, as Spark writes sizes."""
    number = value.rstrip("bBkKmMgG")
    return int(number) << {"k": 10, "m": 20, "g": 30}.get(value[len(number) : len(number) + 1].lower(), 0)


def only(cache: dict) -> dict:
    """``cache``, with what other operators remembered in this worker forgotten: one memory at a time.

    A memory with a ``forget`` lets go of more than its entries."""
    for other in _caches:
        if other is not cache:
            getattr(other, "forget", other.clear)()
    if not any(c is cache for c in _caches):
        _caches.append(cache)
    return cache


def give_back() -> None:
    """Return the memory that this worker has freed to the system; its allocators would keep most of it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def tidy(function: Callable) -> Callable:
    """``function``, which makes a task's batches, with freed memory given back after each of them and at its end.

    Workers stay between tasks, and count among an executor's memory while Spark sorts and joins."""

    @functools.wraps(function)
    def run(*args, **kwargs):
        try:
            for batch in function(*args, **kwargs):
                yield batch
                del batch
                give_back()
        finally:
            give_back()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it.

    Where it names none, a local session gets a temporary one; on a cluster no folder of one machine will do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = context_dir.get() if context_dir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='keystrata-checkpoint-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


_cleaned: set[str] = set()


def _stage_root(spark: SparkSession) -> str:
    """The application's folder of staged tables, deleted when the driver ends."""
    root = f"{shared_dir(spark)}/keystrata/{spark.sparkContext.applicationId}"
    if root not in _cleaned:
        _cleaned.add(root)
        atexit.register(_delete, spark, root)
    return root


def _delete(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None:  # the session may be stopped already
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: The folders of the tables that the blocks of ``passing`` now open have staged, outermost first.
_open: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("open", default=())


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and return the reread table, whose lineage is cut."""
    return _staged(df, name, _open.get())


def _staged(df: DataFrame, name: str, blocks: tuple[list[str], ...]) -> DataFrame:
    spark = df.sparkSession
    path = f"{_stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    if blocks:
        blocks[-1].append(path)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A block whose staged tables are deleted when it ends, whether it fails or not.

    It yields a function like ``stage`` for the tables that outlive the block; what they are computed from may go, as
    they are written. Executors keep shuffle files for as long as the driver holds the plans they belong to, which can
    be until its heap is full, so the driver collects its garbage at the end."""
    outer, own = _open.get(), []
    token = _open.set((*outer, own))
    try:
        yield lambda df, name: _staged(df, name, outer)
    finally:
        _open.reset(token)
        for path in own:
            _delete(spark, path)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def unstage(df: DataFrame) -> None:
    """Delete what ``stage`` wrote for ``df``; only for tables that nothing reads any more."""
    spark = df.sparkSession
    root = _stage_root(spark).rpartition("/keystrata/")[2]
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if f"/{root}/" in folder:
            _delete(spark, folder)


def local(df: DataFrame):
    """The rows of a table of bounded size on the driver, as they came in Arrow batches."""
    return df.toArrow().to_pandas()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; ids that are null count as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def crc_mod_py(doc_id, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(int(doc_id)).encode()) % n


#: Bytes of a table that may be sent to every task.
BROADCAST_BYTES = 16 << 20


def sent_if_small(df: DataFrame, row_bytes: Column | int) -> DataFrame:
    """``df`` marked for a broadcast join if its rows are measured to be small together; else Spark joins by shuffles.

    ``df`` should be staged: it is read to be measured."""
    size = df.agg(F.coalesce(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each lengthened until no column and no other of them has it, whatever the case of its letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: A key is hot if it holds more rows than this part of all and than this number.
HOT_PART, HOT_LEAST = 1000, 20_000


def spread_join(
    many: DataFrame, few: DataFrame, on: str | list[str], how: str = "inner", counts: DataFrame | None = None, part: int = HOT_PART, least: int = HOT_LEAST
) -> DataFrame:
    """``many.join(few, on, how)``, with the rows of hot keys of ``many`` dealt over several tasks.

    Fewer than ``part`` keys can each hold more than the part of all rows, so these keys, and nothing else, come to
    the driver and go to all tasks. Their rows are dealt by a hash of all columns, and their rows of ``few`` are
    repeated for every share. ``counts`` has the rows ``n`` of each key of ``many``; without it ``many`` is read to be
    measured and should be staged. ``how`` is inner or left."""
    on = [on] if isinstance(on, str) else list(on)
    total = many.count() if counts is None else counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(least, total // part)
    if total <= limit:
        return many.join(few, on, how)
    counts = many.groupBy(*on).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    hot = counts.where(F.col("n") > limit).select(*on, "n").collect()
    if not hot:
        return many.join(few, on, how)
    n, share = fresh([*many.columns, *few.columns], "parts", "share")
    types = ", ".join(f"`{c}` {dict(many.dtypes)[c]}" for c in on)
    keys = F.broadcast(many.sparkSession.createDataFrame([(*[r[c] for c in on], -(-r["n"] // limit)) for r in hot], f"{types}, {n} long"))
    dealt = many.join(keys, on, "left").withColumn(share, F.coalesce(F.pmod(F.xxhash64(*many.columns), F.col(n)), F.lit(0).cast("long"))).drop(n)
    shares = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(n), F.lit(1).cast("long")) - 1))
    copied = few.join(keys, on, "left").withColumn(share, shares).drop(n)
    return dealt.join(copied, [*on, share], how).drop(share)


def drawn(column: Column, wanted: int, rows: int) -> Column:
    """True for about three times ``wanted`` of ``rows`` rows, or all if there are few, by a hash of ``column``.

    A draw that is filtered like this before it is sorted brings a bounded number of rows together, however many
    tasks there are. The same rows are drawn every time."""
    if rows <= 4 * wanted:
        return F.lit(True)
    return F.pmod(F.xxhash64(column), F.lit(1 << 40)) < F.lit(-(-3 * wanted * (1 << 40) // rows))


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Component of each vertex of ``edges(u, v)`` as rows ``(u, root)``, root the smallest vertex of the component.

    Large-star and small-star rounds over DataFrames. Each round only takes minima per vertex, which Spark combines
    before it shuffles, and joins them back, the edges of a hot vertex dealt over several tasks; no neighbourhood is
    ever gathered in one row, and no edge comes to the driver. Rounds go on until the edges no longer change, which
    takes a number that grows with the logarithm of the longest path. An empty edge table gives an empty result.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v")
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else both.select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large stars start from a staged table; their result has no vertex with many smaller neighbours
        joined = spread_join(both, least, "u") if large else both.join(least, "u")
        if large:
            return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = stage(edges.select("u", "v").where("u <> v").distinct(), name)
    seen = mark(now)
    settled = False
    while not settled:
        after = stage(star(star(now, True), False), name)
        now_seen = mark(after)
        unstage(now)
        now, settled, seen = after, now_seen == seen, now_seen
    return now.select("u", F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())

"""Secret scans over an incremental ledger of blobs, with Spark expressions only.

Every text is a blob named by its content. The ledger holds one row for each (blob, rule version) pair that was
scanned, with the spans found. A scan takes the distinct blobs of the documents' versions, drops the pairs that the
ledger has, scans the rest once each, adds them to the ledger, and joins the findings back to every document that
holds the blob. Scanning a new version of a corpus therefore scans only texts that no earlier version had. A ledger
is a folder of Parquet files that a scan appends to; without a path, a scan starts from an empty one and leaves none.

Blobs meet by their digests. A text travels with its digest only if a cheap necessary condition of some rule holds for
it, which is tested as the text is hashed; all others enter the ledger without spans.

Offsets are counted in code points. A rule's matches are found with the regular expression engine of Spark; the text
between matches and the matches themselves give every start and end by running sums of their lengths. Running sums
and maxima double their reach step by step, so n spans take n log n steps.

Cases: a null text counts as empty and has no spans; very long texts are scanned whole; equal texts are scanned once
and reported for each row; spans that start together are ordered by the rules' order; an empty table gives no rows;
columns other than the id and the text are ignored by scans and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, sent_if_small, spread_join, stage
from .quality_rules import let


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates, leftmost first and without overlap; ``group`` must have ``least`` characters.

    ``hint`` is a cheap necessary condition: a text without a match of it has no match of the pattern."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    hint: str | None = None


# The base patterns. For ``access`` and ``hex`` the least length stands in the pattern: a run that is
# long enough is matched whole, and a shorter one holds no match.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"(?i)passw|secret|token|api_?key"),
    Rule("access", r"AKIA[A-Z0-9]{16,}", hint="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Spans that the base patterns leave out.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----", hint="-----BEGIN "),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", hint="eyJ"),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}", hint="gh[pousr]_"),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", hint="xox[abprs]-"),
)
RULES = BASE + ADDED

_SPAN = "struct<start:int,ord:int,kind:string,end:int>"
_LEDGER = f"blob string, version string, spans array<{_SPAN}>"


def version(rules: tuple[Rule, ...] = RULES) -> str:
    """Names the rules by their content, so that a changed rule is a new version."""
    import hashlib

    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def running(values: Column, merge) -> Column:
    """Of every element, ``merge`` of it and all before it; ``merge`` is associative and commutative.

    After step k an element covers the last 2**k ones, itself included."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int"))

    def double(acc: Column, k: Column) -> Column:
        return F.transform(acc, lambda x, i: F.when(i >= F.call_function("shiftleft", F.lit(1), k), merge(x, F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)))).otherwise(x))

    return F.aggregate(steps, values, double)


def _spans_of(text: Column, rule: Rule, order: int) -> Column:
    """The spans of one rule, by start."""
    empty = F.lit([]).cast(f"array<{_SPAN}>")
    pattern = F.lit(rule.pattern)

    def found(pair: Column) -> Column:
        sizes = F.transform(pair["whole"], lambda m: F.length(m))
        # where each match ends: the text before it, the match, and all that was before both
        steps = F.transform(pair["whole"], lambda m, i: F.length(F.get(pair["between"], i)) + F.length(m))
        return let(running(steps, lambda x, y: x + y), lambda ends: spans(pair, sizes, ends))

    def spans(pair: Column, sizes: Column, ends: Column) -> Column:
        named_ = F.zip_with(
            ends, sizes, lambda end, size: F.struct((end - size).alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        )
        return F.filter(named_, lambda s, i: F.length(F.get(pair["judged"], i)) >= rule.least).cast(f"array<{_SPAN}>")

    parts = F.struct(
        F.split(text, rule.pattern, -1).alias("between"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("judged"),
    )
    return F.when(text.rlike(rule.hint or rule.pattern), let(parts, found)).otherwise(empty)


def scan_text(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text, by start and then by the rules' order."""
    return F.sort_array(F.concat(*[_spans_of(text, r, i) for i, r in enumerate(rules)]))


def suspect(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """False for texts in which no rule can match."""
    out = F.lit(False)
    for r in rules:
        out = out | text.rlike(r.hint or r.pattern)
    return out


def empty_ledger(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.createDataFrame([], _LEDGER)


def read_ledger(docs: DataFrame, path: str) -> DataFrame:
    """The ledger kept at ``path``, empty if there is none yet."""
    spark = docs.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return empty_ledger(docs)
    return spark.read.schema(_LEDGER).parquet(path)


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger rows that ``docs(text)`` lacks: unseen (blob, rule version) pairs, scanned once each."""
    name = version(rules)
    text = F.coalesce(F.col("text"), F.lit(""))
    blobs = docs.select(blob_of(F.col("text")).alias("blob"), F.when(suspect(text, rules), text).alias("text"))
    # a text has one blob: the copies meet before they are scanned, each partition first among its own
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("version") == name).select("blob"), "blob", "left_anti")
    none = F.lit([]).cast(f"array<{_SPAN}>")
    spans = F.when(F.col("text").isNull(), none).otherwise(scan_text(F.col("text"), rules))
    return blobs.select("blob", F.lit(name).alias("version"), spans.alias("spans"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings of each row of ``docs(doc_id, text)``, ``(doc_id, blob, spans)``, and the ledger after the scan.

    The ledger before it is ``ledger``, or the one kept at ``path``, which the new rows are appended to; else it is
    empty. The new rows are staged, so they are computed once. Blobs without a finding stay in the ledger but take no
    part in the join: only the few with findings go back to the documents."""
    if path is not None:
        ledger = read_ledger(docs, path)
    new = stage(update_ledger(docs, ledger, rules), "ledger")
    if path is not None:
        new.write.mode("append").parquet(path)
    after = new if ledger is None else ledger.unionByName(new)
    # two scans at once may both have added a blob
    hits = after.where((F.col("version") == version(rules)) & (F.size("spans") > 0)).dropDuplicates(["blob"]).select("blob", "spans")
    paths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blob_of(F.col("text")).alias("blob"))
    empty = F.lit([]).cast(f"array<{_SPAN}>")
    found = _back(paths, hits, "blob").select("doc_id", "blob", F.coalesce("spans", empty).alias("spans"))
    return found, after


def _back(paths: DataFrame, hits: DataFrame, blob: str) -> DataFrame:
    """Findings joined to all rows that hold their blob; a blob of very many rows is dealt over several tasks."""
    spans = next(c for c in hits.columns if c != blob)
    hits = stage(hits, "hits")
    sent = sent_if_small(hits, 100 + 32 * F.size(spans))
    if sent is not hits:
        return paths.join(sent, blob, "left")
    return spread_join(paths, hits, blob, "left")


def named(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, ledger: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans of each document."""
    found, _ = scan(docs, ledger, path=path)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


#: Characters of the pieces from which parts of a text are cut.
CHUNK = 1024


def _cut(text: Column, spans: Column, marker: str) -> Column:
    """``text`` with each union of overlapping ``spans``, which are in order, replaced by ``marker``.

    The text is split into pieces once, so a part of it costs no more than its own pieces."""

    def part(chunks: Column, start: Column, end: Column) -> Column:
        piece = lambda c: F.substring(F.get(chunks, c), F.greatest(start - c * CHUNK, F.lit(0)) + 1, F.least(end - c * CHUNK, F.lit(CHUNK)) - F.greatest(start - c * CHUNK, F.lit(0)))
        first, last = F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
        return F.when(end > start, F.array_join(F.transform(F.sequence(first, F.greatest(first, last)), piece), "")).otherwise("")

    def joined(chunks: Column, ends: Column) -> Column:
        before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        kept = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(part(chunks, before(i), s["start"]), F.lit(marker))).otherwise(""))
        rest = let(F.element_at(ends, -1), lambda end: part(chunks, end, F.length(text)))
        return F.concat(F.array_join(kept, ""), rest)

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    ends = running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
    return let(chunks, lambda c: let(ends, lambda e: joined(c, e)))


def redact(docs: DataFrame, marker: str = "[SECRET]", rules: tuple[Rule, ...] = RULES, path: str | None = None) -> DataFrame:
    """``docs`` with every found span replaced by ``marker``; overlapping spans are replaced as one.

    Equal texts meet by content in the ledger, the one kept at ``path`` or an empty one; the text itself stays with
    its row."""
    blob, spans = fresh(docs.columns, "blob", "spans")
    ledger = None if path is None else read_ledger(docs, path)
    new = stage(update_ledger(docs, ledger, rules), "ledger")
    if path is not None:
        new.write.mode("append").parquet(path)
        new = ledger.unionByName(new)
    hits = new.where((F.col("version") == version(rules)) & (F.size("spans") > 0)).dropDuplicates(["blob"])
    joined = _back(docs.withColumn(blob, blob_of(F.col("text"))), hits.select(F.col("blob").alias(blob), F.col("spans").alias(spans)), blob)
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(let(F.struct(F.col("text").alias("t"), F.col(spans).alias("s")), lambda x: _cut(x["t"], x["s"], marker)))
    return joined.withColumn("text", text).select(*docs.columns)


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """``digest`` in DuckDB: texts are scanned row by row, without a ledger."""
    found = []
    for i, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        found.append(
            f"SELECT r, {i} AS ord, '{r.kind}' AS kind, string_split_regex(text, '{p}') AS parts, regexp_extract_all(text, '{p}') AS whole, "
            f"regexp_extract_all(text, '{p}', {r.group}) AS judged, {r.least} AS least FROM d WHERE regexp_matches(text, '{p}')"
        )
    name = "concat(kind, ':', CAST(a AS BIGINT), ':', CAST(a + size AS BIGINT))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(found)}),
i AS (SELECT *, unnest(range(1, len(whole) + 1)) AS n FROM f),
s AS (SELECT r, ord, kind, list_sum(list_transform(parts[:n], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[:n - 1], lambda x: length(x))), 0) AS a,
  length(whole[n]) AS size FROM i WHERE length(judged[n]) >= least),
t AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg({name}, ',' ORDER BY a, ord) FILTER (ord < {len(BASE)}) AS base, string_agg({name}, ',' ORDER BY a, ord) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN t USING (r)"""

"""Quality rules: one Spark projection of text measures, judged by a table of thresholds. No user functions.

Every measure is a Column over the text; ``rules`` compiles the threshold table to one boolean Column for each rule.

Cases: a null text counts as empty, has no words and fails the base rule; very long texts are measured whole, in
time that grows with n log n; ties and repeated rows are judged row by row; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

# The characters that count as symbols, and stop words of the four languages of the corpus.
SYMBOLS = r"[#*$%&|<>]"
STOP_WORDS = (
    "the and of to in is that was for it with as on be at by this have from or are an not "
    "le la les de des du et un une est en que qui dans pour pas au sur il "
    "der die das und ist ein eine den dem von zu mit auf für sich nicht als auch im "
    "el los las y en que del por con no para su al se una como es"
).split()


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie in [least, most]; a bound that is None does not bind."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Thresholds of the verdict; ratios are of words unless said otherwise.
RULES = (
    Rule("words", "n_words", least=50),
    Rule("repeats", "repeat_ratio", most=0.5),
    Rule("mean_word", "mean_word_chars", least=2, most=16),
    Rule("symbols", "symbol_ratio", most=0.1),
    Rule("shouting", "exclaim_ratio", most=0.3),
    Rule("dup_lines", "dup_line_ratio", most=0.5),
    Rule("stop_words", "stop_word_ratio", least=0.01),
)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, whatever the optimiser does with projections."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows whose words occur at least twice in ``words``.

    The windows are sorted with their positions; equal neighbours mark repeated windows, and the sorted positions of
    these give the number of words they cover. Hashes decide only whether a text can have repeats at all, and order
    the windows; equality is that of the words.
    """

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def exact(w: Column) -> Column:
        rows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i")),
        )
        return let(F.sort_array(rows), lambda s: let(F.sort_array(repeats(s)), covered))

    def repeats(s: Column) -> Column:
        found = F.filter(
            s,
            lambda x, j: (F.get(s, j - 1)["t"].eqNullSafe(x["t"])) | (F.get(s, j + 1)["t"].eqNullSafe(x["t"])),
        )
        return F.transform(found, lambda x: x["i"])

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))),
            F.lit(0).cast("long"),
            lambda total, n: total + n,
        )

    none = F.lit(0).cast("long")
    return F.when(F.size(words) < 4, none).otherwise(
        let(words, lambda w: let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(exact(w))))
    )


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id`` with counts of the whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), word_array(text).alias("words"))
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: x.rlike(WORD))
    return first.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(lines, F.size).cast("long").alias("n_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.regexp_count("text", F.lit("!!")).cast("long").alias("n_exclaims"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
    )


def ratios() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "repeat_ratio": F.col("n_repeat_words") / n,
        "mean_word_chars": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "exclaim_ratio": F.col("n_exclaims") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "stop_word_ratio": F.col("n_stop_words") / n,
    }


def compile_rules(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """A Column for each rule, true where the text passes it."""
    named = ratios()
    out = {}
    for r in rules:
        value = named.get(r.measure, F.col(r.measure))
        ok = F.lit(True)
        if r.least is not None:
            ok = ok & (value >= r.least)
        if r.most is not None:
            ok = ok & (value <= r.most)
        out[r.name] = ok
    return out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures, base verdict, verdict and the names of failed rules for each row of ``docs(doc_id, text)``."""
    checks = compile_rules(rules)
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    verdict = F.lit(True)
    for ok in checks.values():
        verdict = verdict & ok
    return measures(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & verdict).alias("kept"),
        F.array_join(failed, ",").alias("failed_rules"),
    )


#: The verdict's counts in DuckDB, for comparison on whole tables. Derived independently: windows are rows here.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\f\\r]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM d WHERE len(words) >= 3),
t AS (SELECT doc_id, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] AS t FROM w),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM t),
p AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM c WHERE c > 1) GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\f\\r]')) AS lines FROM d),
m AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
    len(lines) AS n_lines, len(regexp_extract_all(text, '!!')) AS n_exclaims,
    len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS n_stop_words
  FROM d JOIN l USING (doc_id) LEFT JOIN p USING (doc_id)),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1) AS n FROM m),
f AS (SELECT *, list_filter([
    CASE WHEN n_words < 50 THEN 'words' END, CASE WHEN n_repeat_words / n > 0.5 THEN 'repeats' END,
    CASE WHEN word_chars / n < 2 OR word_chars / n > 16 THEN 'mean_word' END, CASE WHEN n_symbols / n > 0.1 THEN 'symbols' END,
    CASE WHEN n_exclaims / n > 0.3 THEN 'shouting' END, CASE WHEN n_dup_lines / greatest(n_lines, 1) > 0.5 THEN 'dup_lines' END,
    CASE WHEN n_stop_words / n < 0.01 THEN 'stop_words' END], lambda x: x IS NOT NULL) AS failed_rules FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND len(failed_rules) = 0 AS kept, array_to_string(failed_rules, ',') AS failed_rules FROM f
""".replace("{stop}", ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS))))

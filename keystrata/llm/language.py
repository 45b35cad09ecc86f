"""Language identification by compression.

Each language has a dictionary: pieces of training texts up to a fixed number of bytes, as raw content for zstandard.
A text is compressed once with each dictionary, whatever its length by the same strategy; the language whose
dictionary leaves the fewest bytes is chosen. Where the two smallest sizes are close, relative to the text, the answer
is marked as rejected. Dictionaries and texts are in lower case, with one space for every run of ASCII characters that
are no letters, so that capitals and marks do not hide the words.

Every language of the training texts has a dictionary. For each, a bounded number of texts is drawn by hashed id and
cut into pieces; the first pieces of all of them fill the dictionary, then their second pieces, and so on. All
dictionaries together are bounded: where there are very many languages, each gets less.

Cases: a text that is null or has no letter is ``und`` with score 0; equal sizes go to the language whose dictionary
holds more of the text's words, then to the more frequent language, then to the first name; very long texts are
compressed whole; repeated rows get equal answers; with no training rows every text is ``und``; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pandas as pd
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, ship

#: Bytes of a dictionary, and of all of them.
DICTIONARY, ALL = 112 * 1024, 32 << 20
#: Training texts drawn for a dictionary, and characters of a piece of one.
DRAWN, PIECE = 400, 1000
#: A margin below so many bytes, or so large a part of the best size, is narrow.
NARROW_BYTES, NARROW_PART = 2, 0.01
#: How fast the score rises with the margin per byte of text.
SHARPNESS = 60.0


_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def prepared(text: str) -> bytes:
    """Lower case, and single spaces for what is no letter in ASCII."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())


class Model:
    """The dictionaries of all languages, and what breaks ties."""

    def __init__(self, texts: dict[str, tuple[int, list[str]]]):
        self.langs = sorted(texts, key=lambda lang: (-texts[lang][0], lang))
        self.content = [self._join(texts[lang][1], room(len(texts))) for lang in self.langs]

    @staticmethod
    def _join(pieces: list[str], most: int) -> bytes:
        """The pieces in order, as many as there is room for; the last may be cut."""
        return b" ".join(map(prepared, pieces))[:most]


def room(languages: int) -> int:
    """Bytes of each dictionary."""
    return min(DICTIONARY, ALL // max(1, languages))


@functools.lru_cache(maxsize=2)
def _tools(content: tuple[bytes, ...]):
    """A compressor for each dictionary, and its words. Greedy matching of four bytes and more finds words and their
    parts; finer strategies are slower and, on held-out texts, less often right."""
    params = zstd.ZstdCompressionParameters(strategy=zstd.STRATEGY_GREEDY, window_log=18, hash_log=17, chain_log=17, search_log=3, min_match=4, target_length=16, write_content_size=0, write_checksum=0, write_dict_id=0)
    out = []
    for raw in content:
        d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        out.append((zstd.ZstdCompressor(dict_data=d, compression_params=params), frozenset(raw.split())))
    return out


def sizes(text: bytes, content: tuple[bytes, ...]) -> list[int]:
    return [len(tool.compress(text)) for tool, _ in _tools(content)]


def classify(text: str | None, langs: list[str], content: tuple[bytes, ...]) -> tuple[str, float, bool]:
    """Language, score, and whether the margin is too narrow to trust."""
    if text is None or not langs or not any(map(str.isalpha, text)):
        return "und", 0.0, True
    raw = prepared(text)
    size = sizes(raw, content)
    least = min(size)
    tied = [i for i, s in enumerate(size) if s == least]
    best = tied[0]
    if len(tied) > 1:
        parts = raw.split()
        best = max(tied, key=lambda i: (sum(w in _tools(content)[i][1] for w in parts), -i))
    if len(size) == 1:
        return langs[best], 1.0, False
    margin = min(s for i, s in enumerate(size) if i != best) - least
    weights = [math.exp(max(-700.0, -SHARPNESS * (s - least) / len(raw))) for s in size]
    return langs[best], weights[best] / sum(weights), margin < NARROW_BYTES or margin < NARROW_PART * least


def _predict(batches: Iterator[pd.DataFrame], langs: list[str], content: tuple[bytes, ...]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        got = [classify(t, langs, content) for t in batch["text"]]
        out = batch.drop(columns="text")
        for i, name in enumerate(("lang_pred", "score", "rejected")):
            out[name] = [g[i] for g in got]
        yield out


def fit(docs: DataFrame, draw: int = DRAWN) -> Model:
    """Dictionaries from ``docs(doc_id, text, lang)``; a bounded draw of texts for each language, by hashed id.

    What comes to the driver is at most a dictionary's bytes, in characters, and a piece for each language."""
    rows = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    most = room(len(counts))
    spark = docs.sparkSession
    # how many of a language's rows the hash lets through, as a small table
    shares = spark.createDataFrame([(lang, 1 << 40 if n <= 4 * draw else -(-3 * draw * (1 << 40) // n)) for lang, n in counts.items()], "lang string, below long")
    some = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.col("below"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    some = some.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= draw)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(F.length("text"), F.lit(most)) - 1), F.lit(PIECE))
    pieces = some.select("lang", "nth", F.substring("text", 1, most).alias("text"), F.posexplode(starts).alias("piece", "at"))
    pieces = pieces.select("lang", "nth", "piece", F.substring("text", F.col("at") + 1, F.lit(PIECE)).alias("text"))
    before = Window.partitionBy("lang").orderBy("piece", "nth").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).where(F.col("before") < most)
    texts: dict[str, tuple[int, list[str]]] = {lang: (n, []) for lang, n in counts.items()}
    for r in pieces.orderBy("lang", "piece", "nth").select("lang", "text").toLocalIterator():
        texts[r["lang"]][1].append(r["text"])
    return Model(texts)


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` columns with ``lang_pred``, ``score`` and ``rejected`` for each row of ``docs(text)``."""
    ship(docs.sparkSession)
    rows = docs.select(*keep, "text")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    run = functools.partial(_predict, langs=model.langs, content=tuple(model.content))
    return rows.mapInPandas(run, f"{kept}, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose id's crc32 modulo 4 is not 2, predict all rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", crc_mod(F.col("doc_id"), 4) == 2)
    model = fit(rows.where("not held_out"))
    return predict(rows, model, "doc_id", "held_out").select("doc_id", "held_out", "lang_pred", "score", "rejected")

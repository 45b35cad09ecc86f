"""Small awkward tables: nulls, empty and long texts, ties, repeated rows, and columns whose names clash."""

import random

WORDS = "the of alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()
EXTRA = "k long, print long, row long, word string, blob string, whole boolean, starts string, list int, score double, __blob string, __spans string, __whole boolean, __cuts string, __id long, __k string, share long, parts long"


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", ".\n"]) for _ in range(n))


def texts():
    long = prose(4000, 1)
    return [
        (1, long),
        (2, long),  # an exact copy
        (3, long[:9000] + " changed " + long[9000:]),  # nearly one
        (4, ""),
        (5, None),
        (6, "   \n\t "),
        (7, "one"),
        (8, "one two three"),
        (9, prose(60, 2)),
        (9, prose(60, 2)),  # a repeated row
        (10, "é ü 日本語 😀 ß İ x\x0b y\x0cz " + prose(120, 3)),
        (11, "A" * 300 + " " + "ab" * 200),
        (12, " ".join(["echo"] * 150)),
        (13, prose(70, 4) + " " + prose(80, 5)),
        (14, prose(30, 6) + " " + prose(80, 5) + " " + prose(30, 7)),
        (15, "a|b c# d$ " * 40),
        (None, prose(90, 8)),
        (None, prose(90, 8)),
        (16, "line\nline\n\nline\n other \n" * 20),
    ]


def docs(spark, rows=None):
    rows = texts() if rows is None else rows
    made = [(i, t, "en", f"s{n % 3}", None if t is None else len(t)) + (n, n, n, "w", None, None, "", n, 0.5, "b", None, True, "c", n, "k", n, n) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(made, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)


def empty(spark):
    return spark.createDataFrame([], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


def multiset(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)

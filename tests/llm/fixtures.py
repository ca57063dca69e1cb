"""Small tables with what operators must bear: nulls everywhere, empty and long texts, ties, repeated rows, extra columns with clashing names."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, size long, k long, id long, target string, kept string, start string"


def words(r: random.Random, n: int) -> str:
    return " ".join(r.choice("the of and to in is was that for on with as by at from this have or had not but what all were when we there can an your which their said if do will each about how up out them".split()) for _ in range(n))


def documents(spark, n: int = 60, seed: int = 1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        text = words(r, r.randint(1, 120))
        rows.append((i, text, r.choice(["en", "de", None]), r.choice(["a", "a", "b", "é", None]), len(text)))
    long = " ".join(f"w{r.randint(0, 9000)}" for _ in range(6000))
    rows += [
        (100, None, None, None, None), (101, "", "en", "a", 0), (102, " \t\n\x0b\x0c\r ", "en", "a", 7), (103, long, "en", "big", len(long)), (104, long + " x", "en", "big", len(long) + 2), (None, "no id but text that is here", "en", "b", 27),
        (105, rows[0][1], "en", "b", 1), (106, "ein Wort", "de", "", 8), (107, "  nbsp text é 𝄞", "fr", "b", 9), (5, rows[5][1], rows[5][2], rows[5][3], rows[5][4]), (7, "another text under a used id", "en", "a", 28),
    ]
    extra = [(*x, 9, 9, 9, "t", "k", "s") for x in rows]
    return spark.createDataFrame(extra, DOCUMENTS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def rows(df):
    return [r.asDict() for r in df.collect()]

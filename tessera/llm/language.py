"""Predicts the language of a text.

Method: word-first backoff. A known word scores its log frequency in each language; an unseen one scores the longest character n-grams of it that are
known, from five letters down to one.

Learned from labelled rows outside the held-out third, on a sample of about SAMPLE documents of each language at most, chosen by the hash of the id
(a documented bound; all rows where there are fewer), so a rare language is learned from as many documents as a frequent one. All words of the sample and all
n-grams of them are in the model. Every text is scored whole. Letters are the code points of the Unicode categories L.

Defined results: null text and text without letters are `und` with score 0, as is every text where nothing was learned; a null id is never held
out and never learned from; repeated rows each get a row; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import itertools
import re
import sys
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Documents of a language that it is learned from.
SAMPLE = 1500
ORDERS = (5, 4, 3, 2, 1)
#: Unseen words whose scores a task keeps for when they come again.
CACHE = 100_000
UNKNOWN = "und"
#: What Python counts as a word's character by its numeric value, though it is no letter: fractions, circled and Roman numerals and the like.
_NUMERALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
_WORDS = re.compile(r"[^\W\d_]+")
_NUMERAL = frozenset(_NUMERALS)


def letters_of(text: str) -> re.Pattern:
    """The pattern of a text's runs of letters: the class without numerals is slow, and few texts hold any."""
    return _WORDS if text.isascii() or _NUMERAL.isdisjoint(text) else _LETTERS


_LETTERS = re.compile(rf"[^\W\d_{_NUMERALS}]+")
_AT_ONCE = 200_000


class Model:
    def __init__(self, counts: dict[str, dict[str, int]]):
        """counts: by word, how often it occurs in each language."""
        self.langs = sorted({lang for c in counts.values() for lang in c})
        at = {lang: i for i, lang in enumerate(self.langs)}
        total = np.zeros(len(self.langs))
        grams: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.zeros(len(self.langs))) for _ in ORDERS]
        vectors = {}
        for word, by in counts.items():
            v = np.zeros(len(self.langs))
            for lang, n in by.items():
                v[at[lang]] = n
            vectors[word] = v
            total += v
            for table, order in zip(grams, ORDERS, strict=True):
                for g in split(word, order):
                    table[g] += v
        rate = lambda v, n, kinds: np.log((v + 0.1) / (n + 0.1 * kinds)).astype(np.float32)
        self.words = {w: i for i, w in enumerate(vectors)}
        self.scores = rate(np.array([*vectors.values()]).reshape(len(vectors), len(self.langs)), total, len(vectors) + 1)
        self.grams = []
        for table in grams:
            sums = sum(table.values(), np.zeros(len(self.langs)))
            self.grams.append({g: rate(v, sums, len(table) + 1) for g, v in table.items()})

    def unseen(self, word: str) -> np.ndarray:
        for table, order in zip(self.grams, ORDERS, strict=True):
            found = [table[g] for g in split(word, order) if g in table]
            if found:
                return np.mean(found, 0)
        return np.zeros(len(self.langs), np.float32)


def split(word: str, order: int) -> list[str]:
    """The n-grams of the word between its edges; single letters without them."""
    edged = f"^{word}$" if order > 1 else word
    return [edged[i : i + order] for i in range(len(edged) - order + 1)]


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, len(model.words)
        self.table = np.vstack([model.scores, np.zeros((CACHE, len(model.langs)), np.float32)])
        self.at = dict(model.words)

    def place(self, word: str) -> int:
        if len(self.at) - self.known >= CACHE:
            self.at = dict(self.model.words)
        i = self.at[word] = len(self.at)
        self.table[i] = self.model.unseen(word)
        return i

    def __call__(self, text: str | None) -> tuple[str, float]:
        langs, total, any_word = self.model.langs, np.zeros(len(self.model.langs)), False
        low = (text or "").lower()
        pattern = letters_of(low)
        words = (m.group() for m in pattern.finditer(low)) if len(low) > 1_000_000 else iter(pattern.findall(low))
        while part := list(itertools.islice(words, _AT_ONCE)):
            any_word = True
            for some in (part[i : i + CACHE // 2] for i in range(0, len(part), CACHE // 2)):
                if len(self.at) - self.known + len(some) >= CACHE:
                    self.at = dict(self.model.words)
                get, place = self.at.get, self.place
                ids = [i if (i := get(w)) is not None else place(w) for w in some]
                total += self.table[ids].sum(0, dtype=np.float64)
        if not any_word or not langs:
            return UNKNOWN, 0.0
        p = np.exp(total - total.max())
        best = int(np.argmax(total))
        return langs[best], float(p[best] / p.sum())


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    own = docs.select("doc_id", "text", "lang").filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = common.small(common.save(own.groupBy("lang").agg(F.count("*").alias("_n"))))
    own = own.join(sizes, "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) < F.lit(float(sample)) / F.col("_n") * (1 << 30))
    words = own.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("word"))
    rows = words.groupBy("lang", "word").count()
    kept = rows.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "count"))).alias("by"))
    counts = {r["word"]: r["by"] for r in kept.orderBy("word").toLocalIterator()}
    return Model(counts)


def predict(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    model = model or fit(docs)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(known.value)
        for batch in batches:
            found = [score(t.as_py()) for t in batch["text"]]
            lang, sure = zip(*found, strict=True) if found else ((), ())
            yield pa.record_batch([batch["doc_id"], batch["held_out"], pa.array(lang, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")

"""Removes long repeated passages, byte by byte.

Method: prefix-free parsing, with hashes in place of its suffix arrays. Rolling-hash triggers cut the texts into overlapping phrases; the dictionary of
distinct phrases says which of their 100-byte suffixes are equal, and the parse says where each phrase first occurs, which together give every repeated string its
first place in the corpus. Equal suffixes are found by grouping hashes, not by sorting: no suffix array of dictionary or parse is built, and there is no
lexicographic order of the corpus, for the sorted suffixes of the dictionary alone would be several times the input (README).

A trigger is the position with the least hash of TRIGGER bytes among those of a string of `length` bytes, so equal strings have equal triggers at equal
offsets, and each string belongs to exactly one phrase: the phrase of a trigger is the text that its strings cover. Then, from coarse to fine:
phrases whose trigger bytes occur once in the corpus repeat nowhere; a phrase that occurs earlier as a whole repeats as a whole; what is left are first
occurrences of phrases that share their trigger with others, whose suffixes are compared one by one.

Strings are compared by 128 bits (two independent 64-bit hashes: of the trigger or the part that all strings share, and of the whole), never by less.

Defined results: null text is empty; texts shorter than `length` stay whole; rows without an id come after all others; rows that repeat an id
count as one document, so of equal rows none is earlier; an empty table gives an empty table; other columns are not read. Long texts are
parsed in segments that overlap, so no step holds more than SEGMENT bytes of a text at once besides the text itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 100
TRIGGER = 32
SEGMENT = 1 << 19
CELL = 16
LAST = (1 << 63) - 1

_SEEDS = np.random.default_rng(11)
_TABLES = _SEEDS.integers(0, 2**64, (2, 256), np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@lru_cache(maxsize=2)
def powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2 ** 64."""
    base = _BASES[which]
    up = np.full(SEGMENT + 2 * LENGTH, base, np.uint64)
    down = np.full(len(up), pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hashes:
    """Hashes of any part of a segment, from sums of its bytes' values times powers of a base."""

    def __init__(self, data: np.ndarray, which: int):
        up, self.down = powers(which)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[which][data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.down[:n]


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values, by block-wise running minima from both sides."""
    n = len(values)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = values
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first byte, bytes) of parts whose strings of `length` bytes are, together, those of the text, each once."""
    for at in range(0, max(0, len(data) - length + 1), SEGMENT):
        yield at, data[at : at + SEGMENT + length - 1]


_PLACE = np.uint64((1 << 24) - 1)


def phrases(data: np.ndarray, length: int, trigger: int) -> tuple[np.ndarray, ...]:
    """For each phrase of the segment: trigger hash, phrase hash, its first string's start, its last one's distance, the trigger's distance."""
    one = Hashes(data, 0)
    grams = mixed(one.all(trigger))
    low = least((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), length - trigger + 1)
    place = (low & _PLACE).astype(np.int64)
    lo = np.flatnonzero(np.diff(place, prepend=-1))
    hi = np.append(lo[1:], len(place)) - 1
    at = place[lo]
    own = mixed(Hashes(data, 1).of(lo, hi + length) + np.uint64(0x632BE59BD9B4E019) * ((hi - lo) * 4096 + (at - lo)).astype(np.uint64))
    return grams[at].view(np.int64), own.view(np.int64), lo, hi - lo, at - lo


#: Rows of a parse that a task hands over at once.
ROWS_OUT = 50_000
_NAMES = ["k", "c", "doc_id", "lo", "more", "off"]
_KINDS = [np.int64, np.int64, np.int64, np.int32, np.int16, np.int16]


def table_of(parts: list[tuple]) -> pa.RecordBatch:
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    return pa.record_batch([pa.array(x.astype(t)) for x, t in zip(columns, _KINDS, strict=True)], names=_NAMES)


PARSE = "k long, c long, doc_id long, lo int, more short, off short"


def parse(docs: DataFrame, length: int, trigger: int) -> DataFrame:
    """docs: doc_id (LAST for none), text. The parse: a row for each phrase of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            held = 0
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                data = np.frombuffer(text.as_buffer() or b"", np.uint8)
                for at, part in segments(data, length):
                    k, c, lo, more, off = phrases(part, length, trigger)
                    parts.append((k, c, np.full(len(k), doc), lo + at, more, off))
                    held += len(k)
                    if held >= ROWS_OUT:
                        yield table_of(parts)
                        parts, held = [], 0
            if parts:
                yield table_of(parts)

    return docs.mapInArrow(run, PARSE)


def finer(texts: DataFrame, entries: DataFrame, length: int, trigger: int, cell: int) -> DataFrame:
    """Cuts phrases into cells of `cell` strings at offsets from the trigger, as rows of a parse: k hashes what all strings of the cell
    hold, c the cell's whole text. Cells of one string are the phrase's suffixes themselves."""
    reach = length - trigger

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for doc, text, listed in zip(batch["doc_id"].to_pylist(), batch["text"], batch["entries"], strict=True):
                data, rows = np.frombuffer(text.as_buffer(), np.uint8), listed.values.flatten()
                lo, more, off = (x.to_numpy().astype(np.int64) for x in rows)
                first, last = (reach - off) // cell, (reach - off + more) // cell
                count = last - first + 1
                which = np.repeat(np.arange(len(lo)), count)
                j = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]
                base = lo[which] + off[which] - reach + j * cell
                s0, s1 = np.maximum(lo[which], base), np.minimum(lo[which] + more[which], base + cell - 1)
                for at in np.unique(s0 // SEGMENT) * SEGMENT:
                    here = s0 // SEGMENT * SEGMENT == at
                    part = data[at : at + SEGMENT + 2 * length]
                    one, two = Hashes(part, 0), Hashes(part, 1)
                    b, x, y, place = base[here] - at, s0[here] - at, s1[here] - at, j[here].astype(np.uint64)
                    k = mixed(one.of(b + cell - 1, b + length) + place * np.uint64(0x9E6C63D0876A9A35) * np.uint64(cell > 1))
                    c = mixed(two.of(x, y + length) + np.uint64(0x632BE59BD9B4E019) * ((y - x) * 4096 + (x - b)).astype(np.uint64))
                    parts.append((k.view(np.int64), c.view(np.int64), np.full(len(x), doc), x + at, y - x, lo[which][here] + off[which][here] - x - at))
                if len(parts) >= 500:
                    yield table_of(parts)
                    parts = []
            if parts:
                yield table_of(parts)

    total = entries.count()
    listed = entries.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "more", "off")).alias("entries"))
    return texts.join(F.broadcast(listed) if 24 * total <= BOUND else listed, "doc_id").select("doc_id", "text", "entries").mapInArrow(run, PARSE)


#: Bytes of a broadcast of phrases, keys or runs; beyond them the joins shuffle.
BOUND = 48 << 20


def resolved(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """From rows of a parse: the byte runs of phrases that occur earlier as a whole, and the first occurrences of phrases that share k with others.

    `rows` must be saved. Equal phrases meet in sums only: hot ones collapse before the shuffle, and the join back may be split by Spark.
    """
    first = rows.groupBy("k", "c").agg(F.min(F.struct("doc_id", "lo", "more", "off")).alias("f"), F.count("*").alias("n"))
    first = common.save(first.select("k", "c", "f.*", "n"))
    again = first.filter("n > 1").select("k", "c", F.col("doc_id").alias("_doc"), F.col("lo").alias("_lo"))
    later = rows.join(again, ["k", "c"]).filter("doc_id <> _doc or lo <> _lo")
    runs = later.select("doc_id", F.col("lo").cast("int").alias("a"), (F.col("lo") + F.col("more") + length).cast("int").alias("b"))
    # Written, so that the join's two sides are dealt out for the join alone and Spark may split a hot trigger.
    shared = common.save(first.groupBy("k").agg(F.count("*").alias("m")).filter("m > 1").select("k"))
    return runs, first.join(common.small(shared, BOUND), "k", "left_semi").select("doc_id", "lo", "more", "off")


def joined(runs: DataFrame) -> DataFrame:
    """doc_id and its runs, merged where they meet; a list is bounded by its own document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            out = []
            for listed in batch["runs"]:
                a, b = (x.to_numpy().astype(np.int64) for x in listed.values.flatten())
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                starts = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
                out.append([{"a": x, "b": y} for x, y in zip(a[starts].tolist(), b[np.append(starts[1:], len(a)) - 1].tolist(), strict=True)])
            yield pa.record_batch([batch["doc_id"], pa.array(out, kind)], names=["doc_id", "runs"])

    return runs.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("runs")).mapInArrow(run, "doc_id long, runs array<struct<a: int, b: int>>")


def removed(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row; with keep_text=True the remaining bytes as `kept` too."""
    data = F.coalesce("text", F.lit("")).cast("binary")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("text"))
    base = common.save(own.select("doc_id", F.sha2("text", 256).alias("h"), F.octet_length("text").alias("n")))
    count, kinds = base.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if count == kinds:
        own = own.withColumn("id", F.col("doc_id"))
        base = base.withColumn("id", F.col("doc_id"))
    else:  # some ids repeat or are missing: rows are numbered in order
        places = common.global_index(base.select("doc_id", "h").distinct(), [F.col("doc_id").asc_nulls_last(), "h"], "id").select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h"), "id")
        named = lambda x: x.join(common.small(places), x["doc_id"].eqNullSafe(F.col("_doc")) & (x["h"] == F.col("_h"))).drop("_doc", "_h", "h")
        own, base = named(own.withColumn("h", F.sha2("text", 256))), common.save(named(base.withColumn("_key", F.col("h"))).withColumnRenamed("_key", "h"))
    leaders = common.save(base.groupBy("h").agg(F.min("id").alias("leader"), F.max("id").alias("most")).filter("leader < most"))
    copies = common.save(base.filter(F.col("n") >= length).join(leaders, "h").filter("id > leader").select(F.col("id").alias("doc_id"), "n").distinct())
    long = own.filter(F.octet_length("text") >= length).select(F.col("id").alias("doc_id"), "text")
    texts = long.join(common.small(copies.select("doc_id"), BOUND), "doc_id", "left_anti")

    counts = parse(texts, length, trigger).groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k")
    counts = common.save(counts)
    common.settle(docs.sparkSession)
    rows = common.save(parse(texts, length, trigger).join(common.small(counts, BOUND), "k", "left_semi"))
    common.settle(docs.sparkSession)
    whole, entries = resolved(rows, length)
    cells = common.save(finer(texts, common.save(entries), length, trigger, CELL))
    part, entries = resolved(cells, length)
    strings = common.save(finer(texts, common.save(entries), length, trigger, 1))
    last, _ = resolved(strings, length)
    runs = common.save(joined(whole.unionByName(part).unionByName(last)))
    common.settle(docs.sparkSession)
    every = F.array(F.struct(F.lit(0).alias("a"), F.col("n").cast("int").alias("b")))
    runs = runs.unionByName(copies.select("doc_id", every.alias("runs"))).withColumnRenamed("doc_id", "id")
    size = runs.agg(F.sum(F.size("runs"))).first()[0] or 0
    out = own.join(F.broadcast(runs) if 24 * size <= BOUND else runs, "id", "left").select("doc_id", "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            n, gone, spans, digest, kept = [], [], [], [], []
            for text, runs in zip(batch["text"].to_pylist(), batch["runs"].to_pylist(), strict=True):
                parts, at = [], 0
                for r in runs or []:
                    parts.append(text[at : r["a"]])
                    at = r["b"]
                rest = b"".join([*parts, text[at:]])
                n.append(len(text))
                gone.append(len(text) - len(rest))
                spans.append(len(runs or []))
                digest.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            columns = [batch["doc_id"], *(pa.array(x, pa.int64()) for x in (n, gone, spans)), pa.array(digest, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.record_batch(columns + [pa.array(kept, pa.binary())] * keep_text, names=names + ["kept"] * keep_text)

    return out.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)

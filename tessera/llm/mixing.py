"""Mixes sources to target weights, in blocks of words.

Method: each source's words are packed into fixed-length blocks. The mix is a row of shards of fixed size; a shard's counts of slots by
source are a multinomial draw, conditioned on the corpus-wide targets so that the drawn totals meet them exactly. A source's slots,
numbered over all shards, go through a pseudorandom permutation of its block numbers, and the blocks join by number.

Defined results: null text has no words; a null source is a source of its own, last in order; documents without words are taken zero times; a
repeated row counts as a further document; an empty table gives an empty table; other columns are not read. Sources are a dimension of
the mix that every shard's draw needs, MAX_SOURCES at most (8 MB); more raise an error, none is left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
LIMIT = 2.0
BLOCK = 64
SHARD = 4096
SEED = 20240501
MAX_SOURCES = 1_000_000
#: numpy draws from urns of fewer slots; larger urns are drawn from by `urn`, with the same distribution.
DRAWN = 10**9


def permuted(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n), by a Feistel network over the next even number of bits, walked until inside; its inverse with back=True."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, rounds = np.uint64((1 << half) - 1), np.random.SeedSequence(key).generate_state(6, np.uint64)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        left, right = v >> np.uint64(half), v & mask
        if back:
            left, right = right, left
        for k in rounds[::-1] if back else rounds:
            h = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h >> np.uint64(32)) & mask)
        if back:
            left, right = right, left
        v = (left << np.uint64(half)) | right
        out[todo] = v
        todo = todo[v >= np.uint64(n)]
    return out.astype(np.int64)


def _step(x: float, d: float) -> float:
    """log((x + d)! / x!), to the precision of d, not of x, by Stirling's series."""
    if min(x, x + d) < 50:
        return math.lgamma(x + d + 1) - math.lgamma(x + 1)
    return (x + 0.5) * math.log1p(d / x) + d * math.log(x + d) - d + (1 / (x + d) - 1 / x) / 12


def urn(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of n draws without replacement are good: a hypergeometric draw for urns of any size, by ratio of uniforms over the mode."""
    all_of = good + bad
    if not good or not n:
        return 0
    if not bad or n == all_of:
        return min(good, n)
    if 2 * n > all_of:
        return good - urn(good, bad, all_of - n, rng)
    share = good / all_of
    mode = (n + 1) * (good + 1) // (all_of + 2)
    low, high = max(0, n - bad), min(n, good)
    spread = math.sqrt(n * share * (1 - share) * (all_of - n) / max(1, all_of - 1) + 0.5)
    # The table mountain hat of a log-concave distribution with this spread: Stadlober's constants 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e).
    middle, width = n * share + 0.5, 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = math.floor(middle + width * (v - 0.5) / u)
        if low <= k <= high:
            d = k - mode
            if 2 * math.log(u) <= -(_step(mode, d) + _step(good - mode, -d) + _step(n - mode, -d) + _step(bad - n + mode, d)):
                return k


def drawn_from(have: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n draws without replacement from an urn with have[i] slots of the i-th source."""
    total = int(have.sum())
    if total < DRAWN:
        return rng.multivariate_hypergeometric(have, n, method="marginals")
    out = np.zeros(len(have), np.int64)
    for i, own in enumerate(have.tolist()):
        out[i] = urn(own, total - own, n, rng)
        total, n = total - own, n - int(out[i])
    return out


def drawn(totals: np.ndarray, shards: int, shard: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """This shard's slots by source, and how many of each source lie in earlier shards.

    Splits the range of shards in halves down to this one; each half's counts are drawn without replacement from its parent's, by a
    generator seeded with the range, so every shard comes to the same draws alone. Draws without replacement are multinomial
    draws conditioned on their sum.
    """
    lo, hi, have, before = 0, shards, totals.astype(np.int64), np.zeros(len(totals), np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        n, left = int(have.sum()), (mid - lo) * size
        if left >= n:
            part = have.copy()
        else:
            part = drawn_from(have, left, np.random.default_rng([seed, lo, hi]))
        if shard < mid:
            hi, have = mid, part
        else:
            lo, have, before = mid, have - part, before + part
    return have, before


@dataclass
class Mix:
    #: doc_id, source, _null, size, _hash, start: a row for each document, with its first word's number in its source
    documents: DataFrame
    #: source, _null, source_size, weight, target, blocks, slots, index
    sources: DataFrame
    #: shard, slot, index, epoch, block
    slots: DataFrame
    block: int


def sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("_null"),
        F.regexp_count(text, F.lit(common.WORD)).cast("long").alias("size"), F.xxhash64(text).alias("_hash"),
    )


def targets(sources: DataFrame, share: float, limit: float) -> DataFrame:
    """Adds target: share of all sizes by weight, no target above limit times its source's size, the excess reshared by weight.

    Only three sums come to the driver in a round, and a round caps at least one more source or is the last.
    """
    total, capped, rate = float(sources.agg(F.sum("source_size")).first()[0] or 0) * share, -1, 0.0
    while True:
        over = F.lit(False) if capped < 0 else F.col("source_size") * limit <= F.col("weight") * rate
        r = sources.agg(F.sum(over.cast("long")), F.sum(F.when(over, F.col("source_size") * limit)), F.sum(F.when(~over, F.col("weight")))).first()
        n = r[0] or 0
        if n == capped or not r[2]:
            break
        capped, rate = n, max(0.0, total - (r[1] or 0.0)) / r[2]
    return sources.withColumn("target", F.least(F.col("source_size") * F.lit(float(limit)), F.col("weight") * F.lit(rate)))


def slots_for(target: float, size: int, block: int, most: int, key) -> int:
    """The number of slots, `most` at most, whose words come nearest to the target, fewer if two do.

    A source's last block may be short; the permutation says in which slots it comes, so the words of any number of slots are known."""
    blocks = -(-size // block)
    if not blocks:
        return 0
    short = block * blocks - size
    at = int(permuted(np.array([blocks - 1]), blocks, key, back=True)[0])
    words = lambda k: block * k - short * (k // blocks + (k % blocks > at))
    near = int(target * blocks / size)
    return min((min(max(k, 0), most) for k in range(near - 2, near + 4)), key=lambda k: (abs(words(k) - target), k))


def slotted(sources: DataFrame, limit: float, block: int, seed: int) -> DataFrame:
    """Adds slots to the sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch[c].to_pylist() for c in ("target", "source_size", "blocks", "index")), strict=True)
            slots = [slots_for(t, n, block, math.floor(limit * b), [seed, i]) for t, n, b, i in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slots, pa.int64())], names=[*batch.schema.names, "slots"])

    return sources.mapInArrow(run, StructType([*sources.schema, StructField("slots", LongType())]))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> Mix:
    """Plans the mix: which blocks of words of which source fill which slots of which shard."""
    own = common.save(sized(docs))
    sums = common.save(own.groupBy("source", "_null").agg(F.sum("size").alias("source_size")))
    sources = common.global_index(sums, ["_null", "source"], "index")
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("index") % len(weights) + 1).cast("int")))
    sources = targets(sources, share, limit).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    sources = common.save(slotted(sources, limit, block, seed))
    documents = common.running_start(own, ["source", "_null"], ["doc_id", "_hash", "size"], "size", "start")
    n = sources.count()
    if n > MAX_SOURCES:
        raise ValueError(f"{n} sources; a mix holds {MAX_SOURCES} at most")
    vector = sources.orderBy("index").select("slots", "blocks").toPandas()
    totals, blocks = vector["slots"].to_numpy(np.int64), vector["blocks"].to_numpy(np.int64)
    shards = int(-(-int(totals.sum()) // shard))
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast((totals, blocks))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, blocks = known.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                counts, before = drawn(totals, shards, k, shard, seed)
                there = np.flatnonzero(counts)
                index = np.repeat(there, counts[there])
                first = np.cumsum(counts[there]) - counts[there]
                rank = np.arange(len(index)) - np.repeat(first, counts[there]) + before[index]
                number = np.concatenate([permuted(rank[f : f + c] % blocks[i], int(blocks[i]), [seed, int(i)]) for i, f, c in zip(there, first, counts[there], strict=True)] or [np.zeros(0, np.int64)])
                place = np.random.default_rng([seed, k, 1]).permutation(len(index))
                yield pa.record_batch([pa.array(np.full(len(index), k)), pa.array(place), pa.array(index), pa.array(rank // np.maximum(1, blocks[index])), pa.array(number)], names=["shard", "slot", "index", "epoch", "block"])

    tasks = max(1, min(shards, max(spark.sparkContext.defaultParallelism, shards // 64)))
    slots = spark.range(0, shards, 1, tasks).mapInArrow(fill, "shard long, slot long, index long, epoch long, block long")
    return Mix(documents, sources, slots, block)


def pieces(mixed: Mix) -> DataFrame:
    """A row for each part of a document in a block of its source: the document's columns, index, block, and words [low, high) of the document."""
    source = common.small(mixed.sources).select("source", "_null", "source_size", "target", "index")
    block = F.lit(mixed.block).cast("long")
    docs = mixed.documents.filter("size > 0").join(source, ["source", "_null"])
    cut = docs.withColumn("block", F.explode(F.sequence(F.expr(f"start div {mixed.block}"), F.expr(f"(start + size - 1) div {mixed.block}"))))
    low, high = F.greatest(F.col("start"), F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return cut.withColumn("low", low - F.col("start")).withColumn("high", high - F.col("start"))


def taken(mixed: Mix) -> DataFrame:
    """doc_id, source (null again where it was), size, source_size, target and taken for every document."""
    times = mixed.slots.groupBy("index", "block").agg(F.count("*").alias("_times"))
    row = ["doc_id", "source", "_null", "size", "start", "source_size", "target"]
    # The planner takes the slots for as few as the shards they come from and would broadcast them.
    parts = pieces(mixed).join(times.hint("merge"), ["index", "block"], "left")
    full = parts.groupBy(*row).agg(F.sum((F.col("high") - F.col("low")) * F.coalesce("_times", F.lit(0))).alias("taken"))
    source = common.small(mixed.sources).select("source", "_null", "source_size", "target")
    none = mixed.documents.filter("size = 0").join(source, ["source", "_null"]).select(*row, F.lit(0).cast("long").alias("taken"))
    return full.unionByName(none).select(
        "doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), F.when(~F.col("_null"), F.col("source")).alias("source")
    )


_WORDS = re.compile(common.WORD)


def spans(text: str, runs: list[tuple[int, int]]) -> str:
    """The text from the first to the last word of each run of words, joined by line ends; all words together are the text as it is."""
    at = [m.span() for m in _WORDS.finditer(text)]
    joined: list[list[int]] = []
    for low, high in sorted(runs):
        if joined and joined[-1][1] >= low:
            joined[-1][1] = max(high, joined[-1][1])
        else:
            joined.append([low, high])
    if joined == [[0, len(at)]]:
        return text
    return "\n".join(text[at[a][0] : at[b - 1][1]] for a, b in joined)


def mixed_documents(docs: DataFrame, mixed: Mix | None = None) -> DataFrame:
    """The mix as documents: for each time a document's words are taken, a row with its columns and the taken words' text.

    A list of runs is bounded by the document's own length; equal rows (id, source, text) share one copy of the text.
    """
    mixed = mixed or mix(docs)
    parts = pieces(mixed).join(mixed.slots.hint("merge"), ["index", "block"]).groupBy("doc_id", "source", "_null", "_hash", "start", "epoch")
    runs = parts.agg(F.collect_list(F.struct(F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high"))).alias("runs"))
    null = F.col("source").isNull()
    full = docs.select(*common.DOCUMENT).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), null.alias("_null"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"), "text", "lang"
    )
    keys = ["doc_id", "source", "_null", "_hash"]
    full = full.groupBy(*keys).agg(F.first("text").alias("text"), F.first("lang").alias("lang"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [spans(t, [(r["low"], r["high"]) for r in runs]) for t, runs in zip(batch["text"].to_pylist(), batch["runs"].to_pylist(), strict=True)]
            yield pa.record_batch([batch["doc_id"], pa.array(text, pa.string()), batch["lang"], batch["source"], pa.array(map(len, text), pa.int64())], names=list(common.DOCUMENT))

    full = full.join(runs, keys).select("doc_id", "text", "lang", F.when(~F.col("_null"), F.col("source")).alias("source"), "runs")
    return full.mapInArrow(cut, "doc_id long, text string, lang string, source string, n_chars long")

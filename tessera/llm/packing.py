"""Packs documents into as few fixed-length token sequences as best-fit can.

Method: length-histogram planning. Best-fit decreasing runs over the counts of the at most `capacity` lengths, so the plan has a few thousand
lines however many documents there are; a piece then takes its planned slot by its rank within its length.

Defined results: null text is empty and packs as its end token alone; a repeated row is packed again; an empty table gives an empty
table; other columns are not read. A text longer than a sequence is cut into whole sequences with the remainder first.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY = 1024
END = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str | None):
    """A function from a text to its ids. `ranks` names the same vocabulary as merge ranks, which gives equal ids in a quarter of the time;
    texts that spell a special token go through the tokenizer file itself."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary)
    slow = lambda text: whole.encode(text, add_special_tokens=False).ids
    if ranks is None:
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    return lambda text: slow(text) if any(s in text for s in special) else fast(text)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the remainder, if any, then whole sequences."""
    first = n % capacity
    return [(0, first)] * (first > 0) + [(s, capacity) for s in range(first, n, capacity)]


def tokenized(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None, ranks: str | None = None, ids: bool = False) -> DataFrame:
    """A row for each piece of each document; with ids=True its token ids too."""
    own = None if vocabulary is None else (vocabulary, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*(own or default_vocabulary()))
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.array([*encode(text.as_py() or ""), end], "<u4")
                for k, (start, length) in enumerate(cut(len(tokens), capacity)):
                    piece = tokens[start : start + length]
                    rows.append((doc, k, start, length, zlib.crc32(piece.tobytes()), *([piece.astype(np.int32)] if ids else ())))
            columns = list(zip(*rows, strict=True)) or [()] * (5 + ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names=names[: 5 + ids])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES + ", ids array<int>" * ids)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing over counts: (pattern, how many sequences have it), a pattern being (length, times) in order.

    A step puts as many pieces of a length as fit into all sequences of one pattern, so it makes at most two new patterns: there are
    O(capacity) of them, whatever the counts.
    """
    free: list[list[tuple[tuple, int]]] = [[] for _ in range(capacity + 1)]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = next((r for r in range(length, capacity) if free[r]), None)
            pattern, n = free[room].pop() if room is not None else ((), left)
            room = capacity if room is None else room
            each = min(room // length, left)
            used = min(n, left // each)
            if used < n and pattern:
                free[room].append((pattern, n - used))
            free[room - each * length].append(((*pattern, (length, each)), used))
            left -= used * each
    return [g for room in free for g in room]


def slots(planned: list[tuple[tuple[tuple[int, int], ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): the pieces of a length take the slots by rank."""
    out, taken, sequence = [], {}, 0
    for pattern, n in planned:
        offset = 0
        for length, times in pattern:
            for _ in range(times):
                rank = taken.get(length, 0)
                out.append((length, rank, rank + n, sequence, offset))
                taken[length] = rank + n
                offset += length
        sequence += n
    return out


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a saved table of pieces. The histogram has at most `capacity` lines and the slots are bounded by a
    function of capacity alone, so both may be held by the driver and broadcast."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = spark.createDataFrame(slots(plan(histogram, capacity)), "_length long, _from long, _to long, _sequence long, offset long")
    ranked = common.running_start(pieces.withColumn("_one", F.lit(1)), ["length"], ["doc_id", "piece", "start", "ids_crc32"], "_one", "_rank")
    there = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    return ranked.join(F.broadcast(table), there).withColumn("sequence_id", F.col("_sequence") + F.col("_rank") - F.col("_from"))


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    pieces = common.save(tokenized(docs, capacity, end, vocabulary, ranks))
    return packed(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """The sequences themselves: sequence_id and its ids in order; a sequence has at most `capacity` ids."""
    pieces = common.save(tokenized(docs, capacity, end, vocabulary, ranks, ids=True))
    parts = packed(pieces, capacity).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
    return parts.select("sequence_id", F.flatten(F.transform("_parts", lambda p: p["ids"])).alias("ids"))

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing

from .fixtures import documents, empty, rows

VOCABULARY, RANKS = packing.default_vocabulary()


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 60), max_size=20))
@settings(max_examples=60, deadline=None)
def test_plan_places_every_piece_once_and_tightly(histogram):
    planned = packing.plan(histogram, 50)
    placed = {}
    for pattern, n in planned:
        assert sum(length * times for length, times in pattern) <= 50
        for length, times in pattern:
            placed[length] = placed.get(length, 0) + n * times
    assert placed == histogram
    free = []  # best-fit decreasing, document by document
    for length in sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True):
        fits = [r for r in free if r >= length]
        if fits:
            free.remove(min(fits))
        free.append((min(fits) if fits else 50) - length)
    assert sum(n for _, n in planned) == len(free)


def test_pieces_and_places(spark):
    docs = documents(spark)
    tokens = Tokenizer.from_file(VOCABULARY)
    want = []
    for r in rows(docs):
        ids = np.array([*tokens.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(str(r["doc_id"]), k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 1024))]
    got = rows(packing.pack(docs))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024
    assert len(by) <= -(-sum(r["length"] for r in got) // 1024) + 2


def test_only_the_first_piece_is_shorter():
    assert packing.cut(2100, 1024) == [(0, 52), (52, 1024), (1076, 1024)] and packing.cut(1024, 1024) == [(0, 1024)] and packing.cut(3, 1024) == [(0, 3)]


@pytest.mark.parametrize("text", ["", "plain words", "<|endoftext|> inside", "é𝄞  \n\n  x", "a" * 3000, "1234567 $$$ don't"])
def test_ranks_give_the_vocabulary_files_ids(text):
    assert list(packing.encoder(VOCABULARY, RANKS)(text)) == list(packing.encoder(VOCABULARY, None)(text))


def test_sequences_hold_the_ids(spark):
    docs = documents(spark, 20)
    assert sum(len(r["ids"]) for r in rows(packing.sequences(docs))) == sum(r["length"] for r in rows(packing.pack(docs)))


def test_empty_table(spark):
    assert rows(packing.pack(empty(spark))) == []

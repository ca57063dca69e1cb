import zlib
from bisect import bisect_left, insort

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from tessera.llm import common, mixing, packing

from . import test_mixing, test_near, test_personal, test_quality
from .fixtures import empty, rows

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = common.save(stages["quality_rules"](spark, docs, SF))
    want = []
    for r in rows(docs):
        n, *_, repeated = test_quality.measured(r["text"])
        if n >= 10 and 100 * repeated <= 20 * n:
            want.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in rows(good)) == sorted(want)
    one = common.save(stages["near_dedup"](spark, good, SF))
    groups = test_near.brute([(r["doc_id"], r["text"]) for r in rows(good)], 5, 80)
    assert sorted(r["doc_id"] for r in rows(one)) == sorted({c for _, c in groups.values()})
    clean = common.save(stages["personal_data"](spark, one, SF))
    before = {r["doc_id"]: r for r in rows(one)}
    after = rows(clean)
    assert len(after) == len(before) and any(test_personal.plain(r["text"]) for r in before.values())
    for r in after:
        want = without_spans(before[r["doc_id"]]["text"], test_personal.plain(before[r["doc_id"]]["text"]))
        assert r == {**before[r["doc_id"]], "text": want, "n_chars": len(want)}
    mixed = common.save(stages["source_mix"](spark, clean, SF))
    assert mixed.columns == docs.columns
    check_mix(after, rows(mixed))
    packed = rows(stages["best_fit_packing"](spark, mixed, SF))
    check_packing(rows(mixed), packed)
    assert len(rows(corpus_pipeline.run(spark, SF))) == len(packed)


def without_spans(text, spans):
    """The text with each stretch that spans cover replaced by the kind of the span that begins it, the longest of those."""
    kinds = [None] * len(text)
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        first = next((kinds[k] for k in range(a, b) if kinds[k]), (kind, a))
        kinds[a:b] = [first] * (b - a)
    return "".join(c if k is None else f"[{k[0].upper()}]" * (k[1] == i) for i, (c, k) in enumerate(zip(text, kinds, strict=True)))


def check_mix(given, got):
    """Each source's words come near the share worked out by rounds, no document is taken more than twice, and rows are runs of their document's words."""
    of = {r["doc_id"]: r for r in given}
    n = lambda t: len(test_mixing.WORD.findall(t))
    sizes, taken, words = {}, {}, {}
    for r in given:
        sizes[r["source"]] = sizes.get(r["source"], 0) + n(r["text"])
    for r in got:
        own = of[r["doc_id"]]
        assert (r["lang"], r["source"], r["n_chars"]) == (own["lang"], own["source"], len(r["text"]))
        parts = [r["text"]] if r["text"] == own["text"] else r["text"].split("\n")
        at = 0
        for part in parts:
            at = own["text"].index(part, at) + len(part) if part in own["text"][at:] else -1
            if at < 0:
                break
        # A document whose own lines end inside a run is looked up word by word.
        if at < 0:
            every = iter(test_mixing.WORD.findall(own["text"]))
            assert all(w in every for w in test_mixing.WORD.findall(r["text"]))
        taken[r["source"]] = taken.get(r["source"], 0) + n(r["text"])
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + n(r["text"])
    for source, target in test_mixing.shares(sizes).items():
        assert abs(taken.get(source, 0) - target) <= mixing.BLOCK / 2
    assert all(words[d] <= 2 * n(of[d]["text"]) for d in words)


def check_packing(given, got):
    """The pieces of every row by the vocabulary file itself, whole sequences, and as few of them as document-by-document best fit needs."""
    tokens = Tokenizer.from_file(packing.default_vocabulary()[0])
    want = []
    for r in given:
        ids = np.array([*tokens.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
        want += [(r["doc_id"], k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 1024))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024
    free = []
    for length in sorted((w[3] for w in want), reverse=True):
        at = bisect_left(free, length)
        insort(free, (free.pop(at) if at < len(free) else 1024) - length)
    assert len(by) == len(free)


def test_stages_bear_an_empty_table(spark):
    docs = empty(spark).select(*common.DOCUMENT)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert rows(docs) == []

import re

import numpy as np

from tessera.llm import mixing

from .fixtures import documents, empty, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shares(sizes, share=1.5, limit=2.0):
    """Water filling by rounds, as the contract words it."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while True:
        left = total - sum(full.values())
        rest = [s for s in names if s not in full]
        w = sum(weight[s] for s in rest)
        target = {s: left * weight[s] / w for s in rest}
        over = [s for s in rest if target[s] > limit * sizes[s]]
        if not over:
            return {**full, **target}
        full |= {s: limit * sizes[s] for s in over}


def test_sizes_and_targets(spark):
    docs = documents(spark)
    got = rows(mixing.taken(mixing.mix(docs)))
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, len(WORD.findall(r["text"] or ""))) for r in rows(docs))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == want
    sizes = {}
    for r in rows(docs):
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
    target = shares(sizes)
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
    for s, t in target.items():
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - t) <= mixing.BLOCK / 2


def test_reruns_agree_and_slots_are_filled_once(spark):
    docs = documents(spark, 40)
    mixed = mixing.mix(docs, shard=16)
    slots = rows(mixed.slots)
    assert sorted((r["shard"], r["slot"]) for r in slots) == [(k // 16, k % 16) for k in range(len(slots))]
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["taken"])
    assert sorted(map(key, rows(mixing.taken(mixing.mix(docs))))) == sorted(map(key, rows(mixing.taken(mixing.mix(docs.repartition(7))))))


def test_slots_come_nearest_to_the_target():
    for size in (1, 5, 64, 65, 130, 1000, 1087):
        blocks = -(-size // 64)
        for i in range(12):
            order = mixing.permuted(np.arange(blocks), blocks, [7, i])
            assert (mixing.permuted(order, blocks, [7, i], back=True) == np.arange(blocks)).all()
            words = [0]
            for k in range(2 * blocks):
                words.append(words[-1] + min(64, size - 64 * int(order[k % blocks])))
            for target in (0.0, size / 3, size * 0.99, size * 1.5, 2.0 * size):
                k = mixing.slots_for(target, size, 64, 2 * blocks, [7, i])
                assert k == min(range(2 * blocks + 1), key=lambda k: (abs(words[k] - target), k))
    assert mixing.slots_for(0.0, 0, 64, 0, [7, 0]) == 0


def test_draws_meet_the_totals_and_permutations_are_whole():
    totals = np.array([100, 0, 37, 5000])
    parts = [mixing.drawn(totals, 40, k, 129, 3) for k in range(40)]
    assert (sum(p[0] for p in parts) == totals).all() and all(p[0].sum() == 129 for p in parts[:-1])
    assert (parts[7][1] == sum(p[0] for p in parts[:7])).all()
    for n in (1, 2, 3, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, [1, 2]).tolist()) == list(range(n))


def test_mixed_documents_hold_the_taken_words(spark):
    docs = documents(spark, 40).filter("doc_id is not null and doc_id not in (5, 7)")
    mixed = mixing.mix(docs)
    taken = {r["doc_id"]: r["taken"] for r in rows(mixing.taken(mixed))}
    text = {r["doc_id"]: r["text"] for r in rows(docs)}
    words = {}
    for r in rows(mixing.mixed_documents(docs, mixed)):
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
        assert all(part in text[r["doc_id"]] for part in r["text"].split("\n")) or r["text"] == text[r["doc_id"]]
    assert words == {k: v for k, v in taken.items() if v}


def test_empty_table(spark):
    assert rows(mixing.taken(mixing.mix(empty(spark)))) == rows(mixing.mixed_documents(empty(spark))) == []


def test_draws_from_large_urns_have_the_same_distribution(monkeypatch):
    r = np.random.default_rng(5)
    for good, bad, n in ((30, 50, 20), (700, 90, 400), (5, 4000, 2100)):
        own, ref = np.array([mixing.urn(good, bad, n, r) for _ in range(6000)]), r.hypergeometric(good, bad, n, 200_000)
        top = max(own.max(), ref.max()) + 1
        assert np.abs(np.cumsum(np.bincount(own, minlength=top)) / len(own) - np.cumsum(np.bincount(ref, minlength=top)) / len(ref)).max() < 0.03
    good, bad, n = 3 * 10**12, 7 * 10**12, 4 * 10**12
    own = np.array([mixing.urn(good, bad, n, r) for _ in range(3000)], float)
    spread = np.sqrt(n * 0.3 * 0.7 * 0.6)
    assert abs(own.mean() - n * 0.3) < 0.1 * spread and abs(own.std() / spread - 1) < 0.06
    # One path for all sizes: totals and earlier counts hold where the top of the tree is a large urn.
    totals = np.array([2 * 10**9, 0, 7 * 10**8, 5])
    size = -(-int(totals.sum()) // 8)
    parts = [mixing.drawn(totals, 8, k, size, 3) for k in range(8)]
    assert (sum(p[0] for p in parts) == totals).all() and (parts[5][1] == sum(p[0] for p in parts[:5])).all()

import math
import random

from tessera.llm import search

from .fixtures import rows

SCHEMA = "vec_id long, embedding array<float>, label int, v string, rank int, score long"


def vectors(seed, n=300, d=12):
    r = random.Random(seed)
    out = [(i, [r.gauss(0, 0.3) if r.random() < 0.7 else 0.0 for _ in range(d)]) for i in range(n)]
    out[60] = (60, out[10][1])
    return out + [(1000, None), (1001, [0.1, None] + [0.0] * 10), (1002, [float("nan")] + [0.1] * 11), (1003, [float("inf")] * 12), (1050, [0.5]), (1051, []), (None, [0.1] * 12), (77, out[77][1]), (1100, [1e4] * 12)]


def brute(data, k, every):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in sorted(good):
        if q % every == 0 and q not in out:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
            out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def table(spark, data):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in data], SCHEMA)


def answers(df):
    out = {}
    for r in rows(df):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(x) for q, x in out.items()}


def floats(data):
    import numpy as np

    return [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in data]


def test_against_brute_force(spark):
    data = floats(vectors(1))
    assert answers(search.top(table(spark, data).repartition(4))) == brute(data, 5, 50)


def test_small_chunks_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 3)
    data = floats(vectors(2, 120, 5))
    assert answers(search.top(table(spark, data).repartition(2), k=3, every=7)) == brute(data, 3, 7)


def test_terms_are_probed_only_while_they_can_matter():
    import numpy as np

    r = np.random.default_rng(3)
    x = np.floor(r.normal(0, 1, (4000, 20)) * np.geomspace(2000, 1, 20))
    shard = search.Shard(np.arange(8), x[:8].copy(), 5)
    for at in range(0, 4000, 500):
        shard.add(np.arange(at, at + 500), x[at : at + 500])
    assert 0 < shard.probed and shard.traversed + shard.probed < 0.5 * x.size * 8
    for q, best in enumerate(shard.best):
        s = x @ x[q]
        s[q] = -np.inf
        assert [i for _, i in best] == np.argsort(-s, kind="stable")[:5].tolist()


def test_a_given_threshold_spares_postings_of_like_terms():
    import numpy as np

    r = np.random.default_rng(4)
    x = r.normal(0, 1, (3000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None])
    s = x[:20] @ x.T
    s[np.arange(20), np.arange(20)] = -np.inf
    fifth = [int(v) for v in np.sort(s, 1)[:, -5]]
    shard = search.Shard(np.arange(20), x[:20].copy(), 5, fifth)
    shard.add(np.arange(3000), x)
    assert shard.probed > 0 and shard.traversed + shard.probed < 0.55 * x.size * 20
    assert all([i for _, i in b] == np.argsort(-s[q], kind="stable")[:5].tolist() for q, b in enumerate(shard.best))


def test_postings_leave_zeros_out():
    import numpy as np

    x = np.zeros((100, 3))
    x[7, 0], x[:, 1] = 5, 2
    held = search.Postings(np.arange(100), x)
    assert held.lists[0][0].tolist() == [7] and held.lists[1][0] is None and len(held.lists[2][0]) == 0


def test_large_components_are_exact_and_scores_end_at_a_long(spark):
    big = [(0, [1e10, 1.0]), (50, [1e18, -1e18]), (1, [1e10, 2.0]), (2, [1e18, 1e18]), (3, [0.5, 0.25]), (100, [1e300, 0.0]), (4, [-1e300, 1.0])]
    top = (1 << 63) - 1
    want = brute(big, 5, 50)
    ends = lambda s: max(-top - 1, min(top, s))
    data = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got = answers(search.top(data))
    assert sorted(got) == [0, 50, 100]
    for q, listed in got.items():
        pairs = [(i, s) for n, i, s in sorted(listed)]
        every = sorted(((-ends(s), i) for _, i, s in brute(big, 7, 50)[q]))[:5]
        assert pairs == [(i, -s) for s, i in every] and len(want[q]) == 5


def test_fewer_than_k_and_empty(spark):
    data = floats([(0, [0.5, 1.0]), (1, [0.5, -1.0]), (50, [0.25, 0.0])])
    assert answers(search.top(table(spark, data))) == brute(data, 5, 50)
    assert rows(search.top(table(spark, []))) == []

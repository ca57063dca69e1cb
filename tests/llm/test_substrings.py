import hashlib
import random

import numpy as np
import pytest

from tessera.llm import substrings as S

from .fixtures import documents, empty, rows, words


def brute(docs, length):
    """Coverage by strings that start earlier; docs with equal ids share their places."""
    first, out = {}, []
    for d, t in docs:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(first.get(w, (d, s)), (d, s))
    for d, t in docs:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < (d, s):
                cover[s : s + length] = b"\1" * length
        rest = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out.append((d, len(b), sum(cover), len([x for x in bytes(cover).split(b"\0") if x]), hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    passages = [words(r, r.randint(15, 60)) for _ in range(4)]
    out = []
    for i in range(40):
        parts = [r.choice(passages) if r.random() < 0.4 else words(r, r.randint(1, 80)) for _ in range(r.randint(1, 5))]
        t = "é ".join(parts)
        out.append((i, t[: r.randint(1, len(t))] if r.random() < 0.3 else t))
    out += [(50, "ab" * 300), (51, "x" + "ab" * 200), (52, "a" * 500), (53, None), (54, ""), (55, out[3][1]), (56, out[3][1]), (57, passages[0] * 3)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    data = corpus(seed)
    got = rows(S.removed(spark.createDataFrame(data, "doc_id long, text string").repartition(3)))
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute(data, 100)


def test_segments(spark, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 1 << 10)
    S.powers.cache_clear()
    r = random.Random(5)
    base = words(r, 900)
    data = np.frombuffer(base.encode(), np.uint8)
    starts = []
    for at, part in S.segments(data, 100):
        _, _, lo, more, _ = S.phrases(part, 100, 32)
        starts += [at + s for a, m in zip(lo, more, strict=True) for s in range(a, a + m + 1)]
    assert starts == list(range(len(data) - 99))
    S.powers.cache_clear()


def test_equal_strings_have_equal_triggers():
    r = random.Random(6)
    passage = words(r, 40)
    found = []
    for before in ("", words(r, 9) + " ", words(r, 50) + "é "):
        data = np.frombuffer((before + passage).encode(), np.uint8)
        _, _, lo, more, off = S.phrases(data, 100, 32)
        at = len(before.encode())
        trigger = {s: a + o for a, m, o in zip(lo, more, off, strict=True) for s in range(a, a + m + 1)}
        found.append([trigger[at + s] - at for s in range(len(passage) - 99)])
    assert found[0] == found[1] == found[2]


def test_odd_rows(spark):
    docs = documents(spark)
    got = rows(S.removed(docs, keep_text=True))
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[103][0]["n_removed"] == 0 and by[104][0]["n_removed"] >= by[104][0]["n_bytes"] - 101
    assert [r["n_removed"] for r in by[5]] == [0, 0] and by[100][0]["n_bytes"] == 0
    assert rows(S.removed(empty(spark))) == []

import re
from collections import Counter

from tessera.llm import quality

from .fixtures import documents, empty, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    t = text or ""
    w = WORD.findall(t)
    five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, covered = Counter(five), set()
    for i, x in enumerate(five):
        if n[x] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures_against_brute_force(spark):
    docs = documents(spark).unionByName(spark.createDataFrame([(900, "a b c d e a b c d e f a b c d e\nx\nx\n #$ \n\nx", "en", "z", 1, 1, 1, 1, "", "", "")], documents(spark).schema))
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, *measured(r["text"])) for r in rows(docs))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows(quality.judge(docs)))
    assert got == want


def test_bad_host_loses_its_documents(spark):
    good, junk = "one two three four five six seven eight nine ten eleven", "few words"
    data = [(i, good if i % 10 == 0 else junk, "en", "junk", 1) for i in range(40)] + [(100 + i, good, "en", f"h{i % 5}", 1) for i in range(150)] + [(900, good, "en", None, 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in rows(quality.judge(docs)) if r["kept"]}
    assert kept == {r["doc_id"] for r in rows(quality.keep_good(docs))} == {100 + i for i in range(150)} | {900}


def test_empty_table(spark):
    assert rows(quality.judge(empty(spark))) == rows(quality.keep_good(empty(spark))) == []

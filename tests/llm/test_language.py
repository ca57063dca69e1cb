import random
import zlib

from tessera.llm import language

from .fixtures import documents, empty, rows


def test_held_out_accuracy(spark):
    r, data = random.Random(3), []
    stems = {"aa": ["la", "le", "ou", "eau", "tion"], "bb": ["der", "sch", "ung", "ein", "ich"], "cc": ["the", "ing", "and", "ea", "st"]}
    for i in range(600):
        lang = r.choice(list(stems))
        data.append((i, " ".join("".join(r.choice(stems[lang]) for _ in range(r.randint(1, 3))) for _ in range(20)), lang if i % 7 else None))
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    want = {d: t for d, _, t in data}
    got = rows(language.predict(docs))
    for x in got:
        assert x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) and 0 <= x["score"] <= 1
    out = [x for x in got if x["held_out"] and want[x["doc_id"]]]
    assert sum(x["lang_pred"] == want[x["doc_id"]] for x in out) / len(out) > 0.97


def test_backoff_goes_from_words_to_shorter_grams():
    model = language.Model({"haus": {"de": 9}, "house": {"en": 9}, "mouse": {"en": 5}, "maus": {"de": 5}})
    score = language.Scorer(model)
    assert score("haus")[0] == "de" and score("blouse")[0] == "en" and score("zhauz")[0] == "de"
    assert score("12 34 !") == ("und", 0.0) and score(None) == ("und", 0.0)
    assert model.grams[0].get("ouse$") is not None and score("u")[0] in ("de", "en")


def test_only_letters_count():
    score = language.Scorer(language.Model({"ja": {"de": 3}, "yes": {"en": 3}}))
    assert score("½ ② ³ Ⅷ 12 _ ٣") == ("und", 0.0) and score("½ja②")[0] == "de" and score("一")[0] in ("de", "en")


def test_a_rare_language_is_learned_from_a_large_table(spark):
    data = [(i, "the thing and the song of them", "en") for i in range(3000)] + [(9000 + i, "der und die sache", "de") for i in range(9)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language.fit(docs, 20)
    assert model.langs == ["de", "en"] and language.Scorer(model)("und die")[0] == "de"


def test_long_texts_in_parts_and_caches_that_fill(monkeypatch):
    monkeypatch.setattr(language, "CACHE", 50)
    score = language.Scorer(language.Model({"ja": {"de": 3}, "yes": {"en": 3}}))
    assert score(" ".join(f"ja{'abcdefghij'[i % 10] * (i // 10 % 9)}" for i in range(3000)))[0] == "de"


def test_odd_rows(spark):
    got = rows(language.predict(documents(spark)))
    assert len(got) == documents(spark).count()
    by = {x["doc_id"]: x for x in got}
    assert by[100]["lang_pred"] == by[101]["lang_pred"] == by[102]["lang_pred"] == "und" and by[None]["held_out"] is False
    assert {x["lang_pred"] for x in got} <= {"en", "de", "fr", "und"}
    assert rows(language.predict(empty(spark))) == []
    unlabelled = documents(spark).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {x["lang_pred"] for x in rows(language.predict(unlabelled))} == {"und"}

"""Stores that change, catalogue files, embedded JSON and rule assembly at their edges: nulls, blanks, ties, empty tables, odd files."""

import pytest

from tessera.operators import attack, exports, facts, keeping
from tessera.sources import files

CASES = "store_id long, ord long, id string, title string, tlp string, active boolean"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_removing_the_active_case_activates_the_first(spark):
    cases = spark.createDataFrame([(1, 0, "a", "A", "red", False), (1, 1, "b", "B", "red", True), (1, 2, "c", None, None, False), (2, 0, "a", "A", "red", True), (3, 0, "x", "X", "red", False), (3, 1, "y", "Y", "red", False)], CASES)
    gone = spark.createDataFrame([(1, "b"), (1, "b"), (2, "a"), (3, "x"), (4, "no")], "store_id long, id string")
    got = {(s, i): act for s, _, i, _, _, act in rows(keeping.removed_cases(cases, gone))}
    assert got == {(1, "a"): True, (1, "c"): False, (3, "y"): False}


def test_a_first_case_and_unknown_ids(spark):
    none = spark.createDataFrame([], CASES)
    new = spark.createDataFrame([(1, "n", "N", "clear")], "store_id long, id string, title string, tlp string")
    added = keeping.added_cases(none, new)
    assert rows(added) == [(1, 0, "n", "N", "clear", True)]
    assert rows(keeping.activated(added, spark.createDataFrame([(1, "no")], "store_id long, id string"))) == rows(added)
    assert rows(keeping.activated(added, spark.createDataFrame([], "store_id long, id string"))) == rows(added)
    patch = spark.createDataFrame([(1, "n", "  ", ""), (1, "no", "x", "x")], "store_id long, id string, title string, tlp string")
    assert rows(keeping.updated_cases(added, patch)) == [(1, 0, "n", "", "clear", True)]


def test_odd_check_lists(spark):
    raw = [None, "", "null", "{}", "7", '{"набор":[]}', '{"свои":[]}', '{"свои":[{"id":"q","steps":["s",null," s "]}]}']
    got = [r[1:] for r in sorted(rows(keeping.check_list(spark.createDataFrame(list(enumerate(raw)), "id long, raw string"))))]
    empty = ("", [], False, [])
    assert got[0] == got[2] == got[3] == got[5] == got[6] == empty
    assert got[4] == got[1] == ("", [], False, ["unreadable: an empty list is taken"])
    assert got[7] == ("Мои проверки", ["s"], True, [])


def test_catalogue_files_of_another_form(spark):
    bad = spark.createDataFrame([('{"techniques":{}}',)], "raw string")
    with pytest.raises(Exception, match="no catalogue"):
        attack.catalogue_of(bad).collect()
    assert rows(attack.catalogue_summary(spark.createDataFrame([("x",), (None,)], "raw string"))) == []
    odd = spark.createDataFrame([('{"techniques":{"T1":["One",[0,9]],"T2":["Two"]},"tactics":["a"]}',)], "raw string")
    assert sorted(rows(attack.catalogue_of(odd))) == [("T1", "One", ["a"]), ("T2", "Two", [])]


def test_embedded_strings():
    long = "w" * 80
    page = f"<script type='application/json'>[\"{long}\",[\"b{long}\"],{{\"k\":\"{long}\"}},\"{'v' * 79}\"]</script>"
    assert files.embedded_strings(page) == [long, "b" + long]
    assert files.embedded_strings(None) == files.embedded_strings("<script type='application/json'>") == []
    assert files.embedded_strings("<script type='application/json'>" + "[" * 100_000 + "</script>") == []


ITEM = "case_id long, ord long, type string, value string, verdict string, verdict_source string, note string, own boolean"


def test_cases_without_rules_or_techniques(spark):
    items = spark.createDataFrame([(1, 0, "domain", "a.example", "clean", None, None, None), (2, 0, "cve", "CVE-2020-1", None, None, None, None), (3, 0, "md5", "0" * 32, None, "", "", False), (3, 1, "ipv4", "203.0.113.1", None, "", "", True)], ITEM)
    got = {r["case_id"]: r for r in exports.assembled(items).collect()}
    assert len(got[1]["notes"]) == len(got[2]["notes"]) == 1 and got[1]["sigma"] is got[2]["yara"] is None
    assert got[3]["suricata"] is None and got[3]["notes"] == ["1 own values are left out", "suricata: nothing to put in a rule"]
    assert exports.assembled(items.limit(0)).count() == 0
    catalogue = spark.createDataFrame([("T1001", "A | B", ["x", "z"]), ("T1002", "None", [])], "id string, name string, tactics array<string>")
    assert attack.coverage_markdown(items, catalogue, ["z"]).count() == 0
    some = spark.createDataFrame([(1, 0, "attack", "t1001", "malicious", "lab", "n\n|m", None), (1, 1, "attack", "T1002", "odd", None, None, None), (1, 2, "attack", "T1009", None, None, None, None), (1, 3, "attack", "T1001", "clean", None, None, None)], ITEM)
    (text,) = (r["text"] for r in attack.coverage_markdown(some, catalogue, ["z"]).collect())
    lines = text.split("\n")
    assert lines[0] == "> Techniques in the case: **3** (in the catalogue: 2). malicious: 1 · unknown: 2."
    assert [x.split(" | ")[0] for x in lines if x.startswith("| ") and "Tactic" not in x] == ["| z", "| x", "| —"] * 2
    assert "| lab | n \\|m |" in text and "[A \\| B](https://attack.mitre.org/techniques/T1001/)" in text and lines[-1] == "> Not in the catalogue: `T1009`"
    (hidden,) = (r["text"] for r in attack.coverage_markdown(some, catalogue, ["z"], client=True).collect())
    assert "lab" not in hidden and "Observation" not in hidden


def test_templates_and_times(spark):
    from pyspark.sql import functions as F

    q = spark.createDataFrame([(1, None), (2, "  "), (3, " a$1 ")], "id long, text string")
    got = {r["template"]: r["search"] for r in facts.templated(q).collect()}
    assert len(got) == 9 and got["title"] == 'intitle:"a$1"'
    t = spark.createDataFrame([(None,), ("x",), ("2024-01-02T03:04:05Z",)], "t string").select(facts.clock(F.col("t")), facts.day(F.col("t")))
    assert rows(t)[:2] == [("--:--", "unknown date")] * 2 and rows(t)[2][1].endswith("01.2024")

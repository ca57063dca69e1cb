import time

import pytest

from tessera.operators import exact, extract


def found(text, **more):
    return {(i.type, i.value): i for i in exact.extract(text, **more)}


def kinds(text):
    return sorted((i.type, i.value) for i in exact.extract(text, loose=False))


PRIORITY = [
    ("see http://203.0.113.7/x", [("url", "http://203.0.113.7/x")]), ("http://a.example.com/?m=u@b.example.com", [("url", "http://a.example.com/?m=u@b.example.com")]), ("a" * 64, [("sha256", "a" * 64)]),
    ("https://t.me/channel", [("tgchan", "https://t.me/channel")]), ("198.51.100.0/24", [("cidr", "198.51.100.0/24")]), ("setup.zip evil.example.com", [("domain", "evil.example.com")]),
    ("T1059 alone", []), ("uses ATT&CK\n\nT1059/001/", [("attack", "T1059.001")]), ("CLASS123 AS64500", [("asn", "AS64500")]), ("БДУ: 2021-12345", [("bdu", "BDU:2021-12345")]), ("сайт.рф", [("domain", "сайт.рф")]),
    ("C:\\Users\\a b\\x.exe", [("winpath", "C:\\Users\\a b\\x.exe")]), ("HKLM\\Software\\Run.", [("regkey", "HKLM\\Software\\Run")]),
]


@pytest.mark.parametrize(("text", "want"), PRIORITY)
def test_priority(spark, text, want):
    assert kinds(text) == want
    native = extract.indicators(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    if "рф" not in text:  # names beyond Latin are left to the exact tier
        assert sorted((r["type"], r["value"]) for r in native) == want


def test_ports_paths_and_records():
    got = found("203.0.113.7:8080 and 198.51.100.9:70000, evil.example.com/a/b).", loose=False)
    assert got["ipv4", "203.0.113.7"].flags == ["port:8080"] and got["ipv4", "198.51.100.9"].flags == []
    assert got["url", "evil.example.com/a/b"].flags == ["ambiguous:no-scheme"] and ("domain", "evil.example.com") not in got
    assert kinds("1,url,http://a.example.com/x,3,4") == [("url", "http://a.example.com/x")]
    assert kinds("see http://a.example.com/x,y here") == [("url", "http://a.example.com/x,y")]


def test_counts_flags_and_context():
    got = found("10.0.0.1 then hxxp://a[.]example[.]com and 10.0.0.1, " + "d" * 32, around=5)
    assert got["ipv4", "10.0.0.1"].n == 2 and got["ipv4", "10.0.0.1"].flags == ["non-routable:private"] and got["ipv4", "10.0.0.1"].context == "10.0.0.1 then"
    assert got["url", "http://a.example.com"].defanged and not got["ipv4", "10.0.0.1"].defanged and got["md5", "d" * 32].flags == ["ambiguous:md5-or-ja3"]


def test_guess_passes():
    h = "0123456789abcdef" * 4
    got = found(f"hash\n{h[:45]}\n{h[45:]}\nuser at mail dot example dot org")
    assert got["sha256", h].flags == ["ambiguous:wrap"] and got["email", "user@mail.example.org"].flags == ["ambiguous:refang"]
    assert {i.type for i in exact.extract(f"{h[:32]}\n{h[32:]}")} == {"md5"}
    column = "\n".join(f"{k:020x}" for k in range(6))
    assert exact.extract(column) == []
    wrapped = found("go to http://a.example.com/long-\npath/x now")
    assert ("url", "http://a.example.com/long-") in wrapped
    joined = found("http://a.example.com/long-\npath/x")
    assert joined["url", "http://a.example.com/long-path/x"].flags == ["ambiguous:wrap"] and ("url", "http://a.example.com/long-") not in joined


def test_pieces_of_wrapped_hashes_are_no_addresses():
    first, second, base58 = "bc12d83eaae55aa090c7026f0dd3e2ebcccd95cf", "6c94670146030fcd618614bafbc1cf650dfea57a", "1" + "a2" * 15 + "b" * 33
    for h, at in ((first, 25), (second, 25), (base58, 31)):
        cut = f"{h[:at]}\n{h[at:]}"
        kind = {40: "sha1", 64: "sha256"}[len(h)]
        for text in (f"hash\n{cut}", f"> x {h[:at]}\n> {h[at:]}.", f"{cut}\nand\n{cut}"):
            assert [(i.type, i.value, i.flags) for i in exact.extract(text)] == [(kind, h, ["ambiguous:wrap"])]
    # It stays where it stands by itself as well, where the hash is not joined, and where the checksum holds.
    for text in (f"{first[:25]} again {first[:25]}\n{first[25:]}", f"{first[:25]}\n\n{first[:25]}\n{first[25:]}"):
        assert found(text)["btc", first[:25]].n == 2 and ("sha1", first) in found(text)
    assert list(found(f"{first[:25]}\n{first[25:]} x")) == [("btc", first[:25])]
    assert exact.wallet("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa") and exact.wallet("3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy") and not exact.wallet("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb")
    assert exact.wallet("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4") and exact.wallet("bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0")
    assert not exact.wallet("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5") and not exact.wallet("1" + "a" * 30)


@pytest.mark.parametrize("make", [lambda n: " " * n, lambda n: "a" * n, lambda n: "http://a.example.com/x " * (n // 24), lambda n: "a." * (n // 2), lambda n: "[.]" * (n // 3), lambda n: "1" * n])
def test_time_grows_in_proportion(make):
    def took(n):
        t = time.process_time()
        exact.extract(make(n), loose=False)
        return time.process_time() - t

    took(2000)
    small, large = took(12_000), took(48_000)
    assert large < 12 * max(small, 0.02)


def test_texts_are_independent(spark):
    docs = spark.createDataFrame([(1, "203.0.113.1"), (2, None), (3, ""), (1, "203.0.113.1")], "doc_id long, text string")
    assert [(r["doc_id"], r["value"], r["n"]) for r in extract.indicators(docs).collect()] == [(1, "203.0.113.1", 2)]
    assert sorted((r["doc_id"], r["value"]) for r in exact.extracted(docs).collect()) == [(1, "203.0.113.1")] * 2


def test_zones_are_the_public_ones(spark, tmp_path):
    from tessera.functions import zones

    path = tmp_path / "zones"
    path.write_text("// c\n# c\nCOM\n*.ck\nco.uk\nрф\nonion\n// ===END ICANN DOMAINS===\nprivate\n", encoding="utf-8")
    assert zones.read(str(path)) == {"com", "ck", "uk", "рф", "xn--p1ai"}
    assert exact.zone("a.co.uk", frozenset({"co.uk"})) == "co.uk" and exact.zone("a.uk", frozenset({"co.uk"})) is None
    if zones.known():
        good, bad = "evil.sbs bad.cfd x.lol y.quest z.monster q.google w.beauty m.bond", "foo.zz a.notazone"
        assert {i.value for i in exact.extract(f"{good} {bad}") if i.type == "domain"} == set(good.split())
        docs = spark.createDataFrame([(1, f"{good} {bad}")], "doc_id long, text string")
        assert {r["value"] for r in extract.indicators(docs).collect()} == set(good.split())

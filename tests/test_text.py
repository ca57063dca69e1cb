"""Rows made for one rule or hazard each; the values are invented."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import exact


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("x")).first()["x"]


REFANG = [
    ("hxxp://a.example.com", "http://a.example.com"), ("h**ps://a.example.com", "https://a.example.com"), ("ht_p://a.example.com", "http://a.example.com"), ("http[://]a.example.com", "http://a.example.com"),
    ("https(:)//a.example.com", "https://a.example.com"), ("meow://a.example.com", "http://a.example.com"), ("fxp://a.example.com", "ftp://a.example.com"), ("a[.]b{dot}c<.>d (dot) e", "a.b.c.d.e"), ("a [точка] b", "a.b"),
    ("a。b．c", "a.b.c"), ("a\\.b", "a.b"), ("x(at)y[@]z", "x@y@z"), ("h[:]80 [//] x [/] y", "h:80//x/y"), ("plain text stays.", "plain text stays."), ("a     [.]b", "a .b"),
]


@pytest.mark.parametrize(("raw", "want"), REFANG)
def test_refang(spark, raw, want):
    assert one(spark, T.refang("v"), raw) == exact.refang(raw) == want


@pytest.mark.parametrize(("raw", "want"), [("u at mail dot example dot org", "u@mail.example.org"), ("host dot example dot com", "host.example.com"), ("a . b", "a.b"), ("end .\nnext", "end .\nnext")])
def test_refang_loose(spark, raw, want):
    assert one(spark, T.refang_loose("v"), raw) == exact.refang_loose(raw) == want


@pytest.mark.parametrize("value", ["http://a.example.com/x", "https://b.example.org", "ftp://c.example.net", "u@d.example.com", "e.example.com"])
def test_defang_is_undone(spark, value):
    assert one(spark, T.refang(T.defang("v")), value) == value


@pytest.mark.parametrize(("raw", "want"), [("http://a/b).", "http://a/b"), ("http://a/(b)", "http://a/(b)"), ("http://a/b)))", "http://a/b"), ("http://a/b»,", "http://a/b"), ("http://a/[x]].", "http://a/[x]"), ("...", "")])
def test_trim_tail(spark, raw, want):
    assert one(spark, T.trim_tail("v"), raw) == exact.trimmed(raw) == want


TYPES = [
    ("https://t.me/channel", "tgchan"), ("discord.gg/abc", "dsinvite"), ("http://a.example.com/x", "url"), ("u@a.example.com", "email"), ("HKLM\\Software\\Run", "regkey"), ("C:\\Windows\\x.dll", "winpath"), ("198.51.100.0/24", "cidr"),
    ("2001:db8::1", "ipv6"), ("203.0.113.7", "ipv4"), ("a" * 128, "sha512"), ("a" * 64, "sha256"), ("a" * 40, "sha1"), ("a" * 32, "md5"), ("cve-2021-12345", "cve"), ("БДУ:2021-12345", "bdu"), ("T1059.001", "attack"), ("AS64500", "asn"),
    ("0x" + "a" * 40, "eth"), ("1" + "a" * 30, "btc"), ("a" * 16 + ".onion", "onion"), ("a.example.com", "domain"), ("setup.zip", "keyword"), ("setup[.]zip", "domain"), ("run.sh", "keyword"), ("host.com", "domain"), ("a.pl", "domain"),
    ("what is this", "keyword"), ("203.0.113.07", "keyword"), ("", None),
]


@pytest.mark.parametrize(("value", "want"), TYPES)
def test_detect_type(spark, value, want):
    assert one(spark, T.detect_type("v"), value) == want


@pytest.mark.parametrize(("ip", "want"), [("10.1.2.3", "private"), ("172.15.0.1", "global"), ("172.31.0.1", "private"), ("192.168.0.1", "private"), ("127.0.0.1", "loopback"), ("169.254.1.1", "link-local"), ("0.0.0.0", "reserved"), ("100.127.0.1", "cgnat"), ("100.128.0.1", "global"), ("224.0.0.1", "multicast-reserved")])
def test_ipv4_class(spark, ip, want):
    assert one(spark, T.ipv4_class("v"), ip) == exact.ipv4_class(ip) == want


def test_ascii_boundaries_and_blanks(spark):
    assert one(spark, F.size(F.regexp_extract_all("v", F.lit(T.P.java(T.P.TYPES["ipv4"])), F.lit(0))), "адрес203.0.113.7,") == 1
    assert one(spark, T.refang("v"), "a\u00a0[.]\u00a0b") == exact.refang("a\u00a0[.]\u00a0b") == "a.b"


@pytest.mark.parametrize(("c", "raw", "want"), [
    (lambda: T.hex_text("v"), "0x48 65:6c-6C,6f", "Hello"), (lambda: T.hex_text("v"), "486", None), (lambda: T.hex_text("v"), "zz", None), (lambda: T.percent_decode("v"), "a%252Fb+c", "a/b c"), (lambda: T.percent_decode("v"), "%zz", None),
    (lambda: T.looks_like_base64("v"), "QUJDREVGR0hJSktM", True), (lambda: T.looks_like_base64("v"), "deadbeefdeadbeef", False), (lambda: T.base64_text("v")["encoding"], "SABlAGwAbABvACAAdwBvAHIAbABkAA==", "UTF-16LE"), (lambda: T.base64_text("v"), "*", None),
    (lambda: T.ipv4_number("v"), "255.255.255.255", 4294967295), (lambda: T.ipv4_number("v"), "1.2.3.04", None), (lambda: T.ipv4_number("v"), "1.2.3.256", None),
])
def test_codecs(spark, c, raw, want):
    assert one(spark, c(), raw) == want


def test_nulls(spark):
    for c in (T.refang("v"), T.defang("v"), T.trim_tail("v"), T.ipv4_class("v"), T.zone("v"), T.hex_text("v"), T.tlp("v")):
        one(spark, c, None)


def test_squeezed(spark):
    text = "".join(f"a{chr(c)}{chr(c)}" for c in (9, 10, 13, 32, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x205F, 0x3000, 0xFEFF, 0x200B, 0xE9))
    assert one(spark, T.squeezed("v"), text) == "a a a a a a a a a a a a a​​a\xe9\xe9"
    assert one(spark, T.squeezed("v"), "é \t\nb") == "é b"

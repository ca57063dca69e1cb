"""Queries over notation, codecs, hashes, address classes and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import lists
from .registry import carrier, query, select, table

DEFANGED = """
c_custkey AS id
concat(CASE c_custkey % 8 WHEN 0 THEN 'hxxps://c' WHEN 1 THEN 'u1[@]mail' WHEN 2 THEN '203[.]0[.]113[.]' WHEN 3 THEN 'fxp://files(dot)example(dot)net/x' WHEN 4 THEN 'meows://m.example.com/' WHEN 5 THEN 'http[:]//h.example.com[/]a' WHEN 6 THEN 'plain.example.com/' ELSE 'hXXp://u[.]example{.}com/' END, c_custkey, CASE c_custkey % 8 WHEN 0 THEN '[.]example[.]com/p' WHEN 1 THEN '[dot]example[.]org' ELSE '' END) AS raw
"""
PLAIN = """
c_custkey AS id
concat(CASE c_custkey % 4 WHEN 0 THEN 'https://c' WHEN 1 THEN 'ftp://f' WHEN 2 THEN 'user' ELSE 'host' END, c_custkey, CASE c_custkey % 4 WHEN 2 THEN '@mail.example.org' ELSE '.example.com' END) AS v
"""
ADDRESS = """
c_custkey AS id
concat(CASE c_custkey % 9 WHEN 0 THEN '10.' WHEN 1 THEN '172.16.' WHEN 2 THEN '192.168.' WHEN 3 THEN '127.0.' WHEN 4 THEN '169.254.' WHEN 5 THEN '0.1.' WHEN 6 THEN '100.64.' WHEN 7 THEN '224.0.' ELSE '203.0.' END, CASE WHEN c_custkey % 9 = 0 THEN '1.' ELSE '' END, c_custkey % 256, '.', c_nationkey) AS ip
"""
HOSTS = """
c_custkey AS id
concat(CASE c_custkey % 4 WHEN 0 THEN 'https://' WHEN 1 THEN 'http://u:p@' ELSE 'HTTPS://' END, CASE c_custkey % 6 WHEN 0 THEN 'www.YouTube.com' WHEN 1 THEN 'sub.virustotal.com' WHEN 2 THEN 'mc.yandex.ru' WHEN 3 THEN 'notyoutube.com' ELSE 'h.example.com' END, CASE c_custkey % 3 WHEN 0 THEN ':8080' ELSE '' END, '/a/b?x=', c_custkey, '#f') AS url
"""


def _refang_sql(inner: str) -> str:
    out = inner
    for p, to in P.REFANG:
        pattern, flags = (P.re2(p).removeprefix("(?i)"), "gi") if p.startswith("(?i)") else (P.re2(p), "g")
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to.replace('$1', chr(92) + '1')}', '{flags}')"
    return out


@query(f"SELECT id, {_refang_sql('raw')} AS value FROM ({select('customer', DEFANGED)})")
def n1_refang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carrier(spark, sf_dir, "customer", DEFANGED).select("id", T.refang("raw").alias("value"))


@query(f"""SELECT id, replace(replace(regexp_replace(regexp_replace(v, '^http(s?)://', 'hxxp\\1://', 'i'), '^ftp://', 'fxp://', 'i'), '.', '[.]'), '@', '[@]') AS value
    FROM ({select("customer", PLAIN)})""")
def n3_defang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carrier(spark, sf_dir, "customer", PLAIN).select("id", T.defang("v").alias("value"))


@query(f"SELECT id, v AS value, true AS same FROM ({select('customer', PLAIN)})")
def n3_defang_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = T.refang(T.defang("v"))
    return carrier(spark, sf_dir, "customer", PLAIN).select("id", back.alias("value"), (back == F.col("v")).alias("same"))


LOOSE = """
c_custkey AS id
concat('write to user', c_custkey, ' at mail dot example dot org or see host', c_nationkey, ' dot example dot com') AS raw
"""


@query(f"SELECT id, concat('write to user', id, '@mail.example.org or see host', n, '.example.com') AS value FROM (SELECT c_custkey AS id, c_nationkey AS n FROM customer)")
def n2_refang_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carrier(spark, sf_dir, "customer", LOOSE).select("id", T.refang_loose("raw").alias("value"))


@query(f"""SELECT id, CASE id % 8 WHEN 0 THEN ['c' || id || '.example.com'] WHEN 1 THEN ['mail' || id || '.example.org']
    WHEN 2 THEN ['203.0.113.' || id] WHEN 3 THEN ['files.example.net'] WHEN 7 THEN ['u.example.com'] ELSE [] END AS "values"
    FROM (SELECT c_custkey AS id FROM customer WHERE c_custkey % 8 NOT IN (2, 1))""")
def n4_defanged_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carrier(spark, sf_dir, "customer", DEFANGED).filter("id % 8 not in (2, 1)").select("id", T.defanged_values("raw").alias("values"))


TAILS = """
c_custkey AS id
concat('https://e.example.com/', c_custkey, CASE c_custkey % 6 WHEN 0 THEN '.' WHEN 1 THEN '),' WHEN 2 THEN '(a)' WHEN 3 THEN '!?"' WHEN 4 THEN '(a)).' ELSE '' END) AS url
"""


@query(f"""SELECT id, 'https://e.example.com/' || id || CASE id % 6 WHEN 2 THEN '(a)' WHEN 4 THEN '(a)' ELSE '' END AS url FROM ({select("customer", TAILS)})""")
def n5_trim_url_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carrier(spark, sf_dir, "customer", TAILS).select("id", T.trim_tail("url").alias("url"))


IDS = """
c_custkey AS id
concat('T', 1000 + c_custkey % 9000, CASE c_custkey % 3 WHEN 0 THEN '.001' WHEN 1 THEN '/002/' ELSE '' END) AS technique
concat('bdu : 20', 10 + c_custkey % 15, '-', 10000 + c_custkey % 90000) AS bdu
"""


@query(f"""SELECT id, 'T' || (1000 + id % 9000) || CASE id % 3 WHEN 0 THEN '.001' WHEN 1 THEN '.002' ELSE '' END AS technique,
    'BDU:20' || (10 + id % 15) || '-' || (10000 + id % 90000) AS bdu FROM (SELECT c_custkey AS id FROM customer)""")
def n6_canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carrier(spark, sf_dir, "customer", IDS).select("id", T.canonical_technique("technique").alias("technique"), T.canonical_bdu("bdu").alias("bdu"))


TEMPLATE = "https://lookup.example.com/?q={{ioc}}&raw={{ioc_raw}}"
ODD = """
c_custkey AS id
concat('a b/', c_custkey, '?x=(y)&z=~', c_nationkey, '!') AS v
"""


@query(f"""SELECT id, replace(replace('{TEMPLATE}', '{{{{ioc}}}}', 'a%20b%2F' || id || '%3Fx%3D(y)%26z%3D~' || n || '!'), '{{{{ioc_raw}}}}', 'a b/' || id || '?x=(y)&z=~' || n || '!') AS url
    FROM (SELECT c_custkey AS id, c_nationkey AS n FROM customer)""")
def n18_expand_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carrier(spark, sf_dir, "customer", ODD).select("id", lists.expanded(F.lit(TEMPLATE), F.col("v")).alias("url"))


_CLASS = """CASE WHEN a = 10 THEN 'private' WHEN a = 172 AND b BETWEEN 16 AND 31 THEN 'private' WHEN a = 192 AND b = 168 THEN 'private' WHEN a = 127 THEN 'loopback'
    WHEN a = 169 AND b = 254 THEN 'link-local' WHEN a = 0 THEN 'reserved' WHEN a = 100 AND b BETWEEN 64 AND 127 THEN 'cgnat' WHEN a >= 224 THEN 'multicast-reserved' ELSE 'global' END"""


@query(f"""SELECT id, ip, {_CLASS} AS class, ((a * 256 + b) * 256 + CAST(string_split(ip, '.')[3] AS BIGINT)) * 256 + CAST(string_split(ip, '.')[4] AS BIGINT) AS number
    FROM (SELECT *, CAST(string_split(ip, '.')[1] AS BIGINT) AS a, CAST(string_split(ip, '.')[2] AS BIGINT) AS b FROM ({select("customer", ADDRESS)}) WHERE length(regexp_replace(ip, '[^.]', '', 'g')) = 3)""")
def x12_f17_ipv4_class_and_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = carrier(spark, sf_dir, "customer", ADDRESS).filter(F.regexp_count("ip", F.lit(r"\.")) == 3)
    return good.select("id", "ip", T.ipv4_class("ip").alias("class"), T.ipv4_number("ip").alias("number"))


@query(f"""SELECT id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '://(?:[^@/]*@)?([^/:]*)', 1)) AS host,
    regexp_extract(url, '://(?:[^@/]*@)?[^/:]*:([0-9]+)', 1) AS port, regexp_extract(url, '[^/:]/(/?[^/][^#]*)', 1) AS path
    FROM (SELECT id, url FROM ({select("customer", HOSTS)})) WHERE false
    UNION ALL SELECT id, CASE id % 4 WHEN 1 THEN 'http' ELSE 'https' END, CASE id % 6 WHEN 0 THEN 'www.youtube.com' WHEN 1 THEN 'sub.virustotal.com' WHEN 2 THEN 'mc.yandex.ru' WHEN 3 THEN 'notyoutube.com' ELSE 'h.example.com' END,
    CASE id % 3 WHEN 0 THEN '8080' ELSE '' END, '/a/b?x=' || id FROM (SELECT c_custkey AS id FROM customer)""")
def f18_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = carrier(spark, sf_dir, "customer", HOSTS)
    return u.select("id", T.url_scheme("url").alias("scheme"), T.url_host("url").alias("host"), T.url_port("url").alias("port"), T.url_path("url").alias("path"))


@query("""SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents""")
def f5_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


@query("""SELECT c_custkey AS id, base64(encode('powershell ' || c_custkey)) AS b64, lower(hex(encode('é' || c_custkey))) AS hex, 'é' || c_custkey AS back,
    'a b' || c_custkey AS url_back, 'UTF-8' AS encoding, 'powershell ' || c_custkey AS b64_back FROM customer""")
def f1_f4_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = carrier(spark, sf_dir, "customer", "c_custkey AS id\nconcat('é', c_custkey) AS t\nconcat('a%2520b', c_custkey) AS u\nconcat('powershell ', c_custkey) AS p")
    b64 = F.base64(F.encode("p", "UTF-8"))
    return c.select(
        "id", b64.alias("b64"), T.text_hex("t").alias("hex"), T.hex_text(F.concat(F.lit("0x"), T.text_hex("t"))).alias("back"), T.percent_decode("u").alias("url_back"),
        T.base64_text(b64)["encoding"].alias("encoding"), T.base64_text(b64)["text"].alias("b64_back"),
    )


RUNS = """
c_custkey AS id
concat('run powershell -enc QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo= then cGF5bG9hZCBudW1iZXIgb25lIGFiYw== and ', CASE WHEN c_custkey % 2 = 0 THEN 'deadbeefdeadbeefdeadbeefdeadbeef' ELSE 'x' END) AS text
"""


@query("SELECT c_custkey AS id, ['QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo=', 'cGF5bG9hZCBudW1iZXIgb25lIGFiYw=='] AS runs FROM customer")
def x21_f6_base64_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carrier(spark, sf_dir, "customer", RUNS).select("id", T.base64_runs("text").alias("runs"))


MIXED = """
c_custkey AS id
CASE c_custkey % 12 WHEN 0 THEN concat('https://a.example.com/', c_custkey) WHEN 1 THEN concat('u', c_custkey, '@example.org') WHEN 2 THEN '203.0.113.9' WHEN 3 THEN '203.0.113.0/24' WHEN 4 THEN md5(concat('', c_custkey)) WHEN 5 THEN concat('CVE-2021-', 10000 + c_custkey) WHEN 6 THEN 'setup.zip' WHEN 7 THEN concat('h', c_custkey, '[.]example[.]com') WHEN 8 THEN 'just words' WHEN 9 THEN concat('AS', c_custkey) WHEN 10 THEN '2001:db8::1' ELSE concat('T', 1000 + c_custkey % 9000) END AS v
"""


@query("""SELECT c_custkey AS id, CASE c_custkey % 12 WHEN 0 THEN 'url' WHEN 1 THEN 'email' WHEN 2 THEN 'ipv4' WHEN 3 THEN 'cidr' WHEN 4 THEN 'md5' WHEN 5 THEN 'cve' WHEN 6 THEN 'keyword'
    WHEN 7 THEN 'domain' WHEN 8 THEN 'keyword' WHEN 9 THEN 'asn' WHEN 10 THEN 'ipv6' ELSE 'attack' END AS type FROM customer""")
def x19_detect_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carrier(spark, sf_dir, "customer", MIXED).select("id", T.detect_type("v").alias("type"))


LISTED = """
c_nationkey AS list
concat('a', c_custkey % 7, '[.]example[.]com, A', c_custkey % 5, '.example.com; 203.0.113.', c_custkey % 4) AS text
"""


@query("""WITH t AS (SELECT c_nationkey AS list, unnest(['a' || (c_custkey % 7) || '.example.com', 'A' || (c_custkey % 5) || '.example.com', '203.0.113.' || (c_custkey % 4)]) AS v FROM customer)
    SELECT list, lower(v) AS key, count(*) AS n, CASE WHEN lower(v) LIKE '203%' THEN 'ipv4' ELSE 'domain' END AS type FROM t GROUP BY list, lower(v)""")
def a4_dedupe_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.deduped(carrier(spark, sf_dir, "customer", LISTED), "list", "text").select("list", "key", "n", "type")


@query("""WITH a AS (SELECT DISTINCT 'h' || (c_custkey % 40) || '.example.com' AS k FROM customer), b AS (SELECT DISTINCT 'h' || (c_custkey % 60 + 20) || '.example.com' AS k FROM customer)
    SELECT coalesce(a.k, b.k) AS key, CASE WHEN b.k IS NULL THEN 'only_a' WHEN a.k IS NULL THEN 'only_b' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k""")
def e1_diff_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = carrier(spark, sf_dir, "customer", "concat('h', c_custkey % 40, '[.]example.com') AS v")
    b = carrier(spark, sf_dir, "customer", "concat('H', c_custkey % 60 + 20, '.example.com') AS v")
    return lists.difference(a, b, "v").select("key", "side")


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN ['alpha', 'beta'] WHEN 1 THEN ['x'] WHEN 2 THEN [] ELSE ['t1','t2','t3','t4','t5','t6','t7','t8','t9','t10','t11','t12'] END AS tags FROM customer""")
def e8_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = carrier(spark, sf_dir, "customer", "c_custkey AS id\nCASE c_custkey % 4 WHEN 0 THEN ' Alpha, beta ,ALPHA' WHEN 1 THEN 'x' WHEN 2 THEN ' , ' ELSE 't1,t2,t3,t4,t5,t6,t7,t8,t9,t10,t11,t12,t13' END AS t")
    return c.select("id", lists.tags("t").alias("tags"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN [] WHEN 1 THEN ['idn:puny'] WHEN 2 THEN ['homograph'] WHEN 3 THEN ['idn:mixed'] ELSE ['homograph'] END AS flags FROM customer""")
def x13_homograph_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = carrier(spark, sf_dir, "customer", "c_custkey AS id\nCASE c_custkey % 5 WHEN 0 THEN 'plain.example.com' WHEN 1 THEN 'xn--80ak6aa92e.com' WHEN 2 THEN 'аpple.com' WHEN 3 THEN 'почта.com' ELSE 'ехаmple.почта.org' END AS d")
    return c.select("id", T.idn_flags("d").alias("flags"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'example.com' WHEN 1 THEN 'example.co.uk' WHEN 2 THEN 'localhost' ELSE 'mailer.example' END AS base FROM customer""")
def n15_base_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = carrier(spark, sf_dir, "customer", "c_custkey AS id\nCASE c_custkey % 4 WHEN 0 THEN 'MX.a.Example.com' WHEN 1 THEN 'mail.example.co.uk' WHEN 2 THEN 'localhost' ELSE 'mx1.mailer.example' END AS d")
    return c.select("id", T.base_domain("d").alias("base"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'TLP:AMBER' WHEN 1 THEN 'TLP:RED' WHEN 2 THEN 'TLP:AMBER+STRICT' END AS tlp FROM customer""")
def f21_tlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = carrier(spark, sf_dir, "customer", "c_custkey AS id\nCASE c_custkey % 4 WHEN 0 THEN 'tlp: amber' WHEN 1 THEN 'RED' WHEN 2 THEN 'TLP:Amber+Strict' ELSE 'secret' END AS t")
    return c.select("id", T.tlp("t").alias("tlp"))

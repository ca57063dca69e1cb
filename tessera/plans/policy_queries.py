"""Queries over noise, ranges, services and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract, graph, noise, ranges, registry
from .registry import carrier, query, select, table
from .text_queries import HOSTS

_URL_HOST = "CASE id % 6 WHEN 0 THEN 'www.youtube.com' WHEN 1 THEN 'sub.virustotal.com' WHEN 2 THEN 'mc.yandex.ru' WHEN 3 THEN 'notyoutube.com' ELSE 'h.example.com' END"


@query("""SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'platform' WHEN 1 THEN 'aggregator' WHEN 2 THEN 'telemetry' WHEN 3 THEN NULL ELSE 'source' END AS noise_reason,
    c_custkey % 6 <> 3 AS noise FROM customer""")
def p1_p2_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = carrier(spark, sf_dir, "customer", HOSTS).select("id", F.lit("url").alias("type"), F.col("url").alias("value"))
    return noise.classified(found, F.lit("example.com")).select("id", "noise_reason", "noise")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents),
    k AS (SELECT *, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) AS key FROM l WHERE n >= 6),
    g AS (SELECT doc_id, key FROM k WHERE key <> '' AND length(key) <= 200 GROUP BY doc_id, key HAVING count(*) >= 3 AND (max(pos) - min(pos)) / greatest(1, first(n) - 1) >= 0.6),
    f AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS kinds FROM g)
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, 'furniture' AS part FROM k JOIN f USING (doc_id, key) WHERE kinds <= 12""")
def p4_w7_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.parts(table(spark, sf_dir, "documents")).filter("part = 'furniture'").select("doc_id", "pos", "part")


REPORT = """
c_custkey AS doc_id
concat('ACME report', chr(10), 'seen ip 203.0.113.', c_custkey % 256, chr(10), 'text one', chr(10), 'ACME report', chr(10), 'text two', chr(10), 'text three', chr(10), 'ACME report', chr(10), 'For more information mail help@example.org', chr(10), 'References', chr(10), 'ip 198.51.100.', c_custkey % 256) AS text
"""


@query("""SELECT c_custkey AS doc_id, CAST(p AS INTEGER) AS pos, CASE WHEN p IN (0, 3, 6) THEN 'furniture' WHEN p = 7 THEN 'contact' WHEN p >= 8 THEN 'refs' END AS part FROM customer, range(10) AS r(p)""")
def p4_p6_document_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.parts(carrier(spark, sf_dir, "customer", REPORT)).select("doc_id", "pos", "part")


@query("""SELECT c_custkey AS doc_id, 'email' AS type, 'help@example.org' AS value, 'contact' AS reason FROM customer
    UNION ALL SELECT c_custkey, 'ipv4', '198.51.100.' || (c_custkey % 256), 'refs' FROM customer""")
def p7_document_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = carrier(spark, sf_dir, "customer", REPORT)
    types = ["ipv4", "email"]
    return noise.document_noise(docs, extract.indicators(docs, types=types), lambda d: extract.indicators(d, types=types))


POLICY = """
n_nationkey AS ord
concat('203.0.113.', n_nationkey * 8, CASE WHEN n_nationkey % 5 = 4 THEN '' ELSE concat('/', 26 + n_nationkey % 5) END) AS cidr
concat('net', n_nationkey) AS label
"""
_POLICY_SQL = f"""SELECT ord, label, base - base % size AS lo, base - base % size + size - 1 AS hi, bits FROM (SELECT *, CAST(pow(2, 32 - bits) AS BIGINT) AS size FROM (
    SELECT n_nationkey AS ord, 'net' || n_nationkey AS label, 3405803776 + n_nationkey * 8 AS base, CASE WHEN n_nationkey % 5 = 4 THEN 32 ELSE 26 + n_nationkey % 5 END AS bits FROM nation))"""
ADDRESSES = """
c_custkey AS id
concat(CASE c_custkey % 3 WHEN 0 THEN '10.0.0.' ELSE '203.0.113.' END, c_custkey % 256) AS ip
"""


@query(f"""SELECT ord, label, lo, hi, bits, CASE WHEN lo <> 3405803776 + ord * 8 THEN 'not the start of the network' END AS error FROM ({_POLICY_SQL})""")
def j10_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.parsed_v4(carrier(spark, sf_dir, "nation", POLICY)).select("ord", "label", "lo", "hi", "bits", "error")


@query(f"""WITH p AS ({_POLICY_SQL}), a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 167772160 ELSE 3405803776 END + c_custkey % 256 AS n FROM customer)
    SELECT id, CASE WHEN min(ord) IS NOT NULL THEN 'policy' WHEN n < 200000000 THEN 'non-routable' END AS own_kind, CASE WHEN min(ord) IS NOT NULL THEN arg_min(label, ord) WHEN n < 200000000 THEN 'private' END AS own_mark
    FROM a LEFT JOIN p ON n BETWEEN lo AND hi GROUP BY id, n""")
def j8_j9_own_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = ranges.parsed_v4(carrier(spark, sf_dir, "nation", POLICY))
    return ranges.owner(carrier(spark, sf_dir, "customer", ADDRESSES), policy).select("id", "own_kind", "own_mark")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 6 >= 4 THEN 'example.com' END AS own_domain FROM customer""")
def j8_own_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = carrier(spark, sf_dir, "customer", HOSTS).select("id", T.url_host("url").alias("host"))
    domains = spark.createDataFrame([(1, "example.com"), (2, "h.example.com"), (3, "corp.example")], "ord int, domain string")
    return ranges.owner_domain(hosts, domains).select("id", "own_domain")


@query("""SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'loopback' WHEN 1 THEN 'link-local' WHEN 2 THEN 'unique-local' WHEN 3 THEN 'multicast' ELSE 'global' END AS class FROM customer""")
def j8_ipv6_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = carrier(spark, sf_dir, "customer", "c_custkey AS id\nCASE c_custkey % 5 WHEN 0 THEN '::1' WHEN 1 THEN 'fe80::1%eth0' WHEN 2 THEN '[fd00::2]' WHEN 3 THEN 'ff02::1' ELSE '2001:db8::203.0.113.9' END AS ip")
    return c.select("id", ranges.v6_class(ranges.v6_bytes(F.col("ip"))).alias("class"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'name' WHEN 1 THEN 'private' WHEN 2 THEN 'loopback' WHEN 3 THEN 'name' END AS reason FROM customer""")
def p12_internal_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = carrier(spark, sf_dir, "customer", "c_custkey AS id\nCASE c_custkey % 6 WHEN 0 THEN 'srv.corp' WHEN 1 THEN '10.2.3.4' WHEN 2 THEN '::1' WHEN 3 THEN 'localhost' WHEN 4 THEN 'example.com' ELSE '203.0.113.1' END AS host")
    return c.select("id", ranges.internal_reason(F.col("host")).alias("reason"))


TOOLS = [
    ("scan", "Scan", "https://scan.example.com/?q={{ioc}}", ["url", "domain"], "public", "free"),
    ("hash", "Hash", "https://hash.example.org/{{ioc_raw}}", ["md5", "sha1"], "limited", "paid"),
    ("net", "Net", "https://net.example.net/{{ioc}}", ["ipv4", "domain"], "internal", "free-account"),
    ("pub", "Pub", "https://pub.example.net/{{ioc}}", ["ipv4", "md5"], "public", "paid"),
]
PLAYBOOKS = [("ip", "Address", ["ipv4"], ["net", "pub", "gone"]), ("dom", "Domain", ["domain", "url"], ["scan", "net", "hash"]), ("pubs", "Public", ["ipv4"], ["pub", "scan"])]
_TOOLS_SQL = ", ".join(f"('{i}', '{u}', {t!r}, '{e}', '{p}')" for i, _, u, t, e, p in TOOLS)
_PLAYBOOKS_SQL = ", ".join(f"('{i}', {t!r}, {s!r})" for i, _, t, s in PLAYBOOKS)
FOUND = """
c_custkey AS id
CASE c_custkey % 4 WHEN 0 THEN 'ipv4' WHEN 1 THEN 'md5' WHEN 2 THEN 'domain' ELSE 'url' END AS type
concat('v', c_custkey) AS value
c_custkey % 5 = 0 AS own
"""


def _tools(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOOLS, "id string, name string, url string, types array<string>, exposure string, pricing string")


def _playbooks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLAYBOOKS, "id string, name string, types array<string>, steps array<string>")


_PIVOT = """WITH t(tool, url, types, exposure, pricing) AS (VALUES {tools}), f AS ({found}),
    r AS (SELECT f.type, f.value, tool, url, CASE WHEN {client} AND exposure = 'public' THEN 'mode' WHEN exposure = 'public' AND own THEN 'own' WHEN pricing = 'paid' THEN 'paid' END AS reason FROM f JOIN t ON list_contains(types, f.type))"""


@query(_PIVOT.format(tools=_TOOLS_SQL, found=select("customer", FOUND), client="false") + " SELECT type, value, tool, reason, CASE WHEN reason IS NULL THEN replace(replace(url, '{{ioc}}', value), '{{ioc_raw}}', value) END AS link FROM r")
def j1_j2_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.pivot(carrier(spark, sf_dir, "customer", FOUND), _tools(spark), "public", True)


@query(_PIVOT.format(tools=_TOOLS_SQL, found=select("customer", FOUND), client="true") + " SELECT coalesce(reason, 'open') AS reason, count(*) AS n FROM r GROUP BY ALL")
def j2_p9_closed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.closed_summary(registry.pivot(carrier(spark, sf_dir, "customer", FOUND), _tools(spark), "client", True))


@query(f"""WITH t(tool, url, types, exposure, pricing) AS (VALUES {_TOOLS_SQL}), p(playbook, ptypes, steps) AS (VALUES {_PLAYBOOKS_SQL}), f AS ({select("customer", FOUND)}),
    s AS (SELECT playbook, ptypes, unnest(steps) AS tool, generate_subscripts(steps, 1) - 1 AS step FROM p)
    SELECT f.type, f.value, playbook, CAST(step AS INTEGER) AS step, s.tool, CASE WHEN t.tool IS NULL THEN 'missing' WHEN NOT list_contains(t.types, f.type) THEN 'type' WHEN exposure = 'public' AND own THEN 'own' END AS skipped
    FROM f JOIN s ON list_contains(ptypes, f.type) LEFT JOIN t ON t.tool = s.tool""")
def j3_playbook_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.plan(carrier(spark, sf_dir, "customer", FOUND), _playbooks(spark), _tools(spark))


@query("SELECT * FROM (VALUES ('ip'), ('pubs')) AS t(id)")
def j4_applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.applicable(_playbooks(spark), ["ipv4", "md5"]).select("id")


@query("SELECT * FROM (VALUES ('ip', 'unknown tool', 'gone'), ('pubs', 'all public', NULL)) AS t(playbook, problem, tool)")
def j5_j7_registry_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.problems(_playbooks(spark), _tools(spark))


@query("SELECT * FROM (VALUES ('mine', 'ipv4', 0), ('mine', 'domain', 0), ('mine', 'url', 1), ('mine', 'md5', 2)) AS t(list, type, ord)")
def j6_derived_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = spark.createDataFrame([("mine", 0, "net"), ("mine", 1, "scan"), ("mine", 2, "pub")], "list string, ord int, tool string")
    return registry.derived_types(steps, _tools(spark))


@query(f"SELECT id, host FROM (SELECT id, {_URL_HOST} AS host FROM (SELECT c_custkey AS id FROM customer)) WHERE host LIKE '%youtube%' OR host LIKE '%.internal%'")
def p11_deny_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = carrier(spark, sf_dir, "customer", HOSTS).select("id", T.url_host("url").alias("host"))
    return registry.deny_listed(hosts, spark.createDataFrame([("youtube",), (".internal",)], "entry string"))


ITEMS = """
c_nationkey AS case_id
c_custkey AS ord
CASE c_custkey % 5 WHEN 0 THEN 'url' WHEN 1 THEN 'domain' WHEN 2 THEN 'email' WHEN 3 THEN 'ipv4' ELSE 'cidr' END AS type
CASE c_custkey % 5 WHEN 0 THEN concat('https://H', c_custkey % 7, '.example.com/', c_custkey) WHEN 1 THEN CASE WHEN c_custkey % 2 = 0 THEN concat('h', c_custkey % 7, '.example.com') ELSE concat('a.b.h', c_custkey % 7, '.example.com') END WHEN 2 THEN concat('u', c_custkey, '@h', c_custkey % 7, '.example.com') WHEN 3 THEN concat('203.0.113.', c_custkey % 256) ELSE concat('203.0.113.0/', 24 + c_custkey % 6) END AS value
CASE WHEN c_custkey % 3 = 0 THEN 'malicious' END AS verdict
CASE WHEN c_custkey % 2 = 0 THEN concat('src', c_custkey % 4) ELSE '' END AS source
"""
_NODES = f"""n AS (SELECT case_id, lower(value) AS key, arg_min(type, ord) AS type, arg_min(value, ord) AS value FROM ({select("customer", ITEMS)}) GROUP BY case_id, lower(value))"""


@query(f"""WITH {_NODES}, i AS ({select("customer", ITEMS)}),
    v AS (SELECT case_id, key, CAST(string_split(value, '.')[4] AS BIGINT) AS d FROM n WHERE type = 'ipv4'), c AS (SELECT case_id, key, CAST(pow(2, 32 - CAST(string_split(value, '/')[2] AS INT)) AS BIGINT) AS size FROM n WHERE type = 'cidr')
    SELECT DISTINCT case_id, lower(value) AS "from", 's:' || source AS "to", 'from-source' AS kind FROM i WHERE source <> ''
    UNION SELECT a.case_id, a.key, b.key, 'part-of' FROM n a JOIN n b ON a.case_id = b.case_id AND ((a.type = 'url' AND b.key = regexp_extract(a.key, '://([^/]*)', 1)) OR (a.type = 'email' AND b.key = string_split(a.key, '@')[2]) OR (a.type = 'domain' AND a.key = 'a.b.' || b.key))
    UNION SELECT v.case_id, v.key, c.key, 'part-of' FROM v JOIN c ON v.case_id = c.case_id AND v.d < c.size""")
def j11_j14_case_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(carrier(spark, sf_dir, "customer", ITEMS))


@query(f"WITH {_NODES} SELECT case_id, count(*) AS total, count(*) >= 11 AS enough FROM n GROUP BY case_id")
def l10_graph_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shown(carrier(spark, sf_dir, "customer", ITEMS))


LINKS = """
o_orderkey AS ord
concat('http://r', o_orderkey % 400, '.example.com') AS url
concat('http://r', (o_orderkey % 400) * 2 + 1, '.example.com') AS target
"""


@query("""WITH RECURSIVE m AS (SELECT DISTINCT o_orderkey % 400 AS u, (o_orderkey % 400) * 2 + 1 AS t FROM orders), s AS (SELECT u FROM m WHERE u NOT IN (SELECT t FROM m)),
    w(start, step, u) AS (SELECT u, 0, u FROM s UNION ALL SELECT w.start, w.step + 1, m.t FROM w JOIN m ON m.u = w.u)
    SELECT 'http://r' || start || '.example.com' AS start, CAST(step AS INTEGER) AS step, 'http://r' || u || '.example.com' AS url FROM w""")
def j18_redirect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.chains(carrier(spark, sf_dir, "orders", LINKS).filter("url <> target"))


@query("""SELECT page_id, length(html) > 25 * length(t) AND length(t) < 900 AS shell FROM (SELECT page_id, html, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM pages)""")
def s12_shell_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " "))
    return table(spark, sf_dir, "pages").withColumn("t", plain).select("page_id", noise.shell_like("html", "t").alias("shell"))


@query("""SELECT c_custkey AS id, c_custkey % 4 IN (0, 3) AS token FROM customer""")
def p13_token_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = carrier(spark, sf_dir, "customer", "c_custkey AS id\nCASE c_custkey % 4 WHEN 0 THEN md5(concat('', c_custkey)) WHEN 1 THEN 'a-long-article-about-things' WHEN 2 THEN 'short' ELSE 'AbCdEfGhIjKlMnOpQr' END AS part")
    return c.select("id", noise.token_like(F.col("part")).alias("token"))

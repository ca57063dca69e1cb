"""Queries over stores, caps, gates and texts for people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import facts, noise, stores
from ..sources import har, mail
from .case_queries import _ITEMS_SQL, EVENTS, _EVENTS_SQL, _items, _techniques
from .policy_queries import ITEMS as CASE_ITEMS
from .policy_queries import _tools
from .registry import carrier, query, select, table
from .text_queries import HOSTS

RAW = """
c_custkey AS id
CASE c_custkey % 3 WHEN 0 THEN concat('{"items":[{"type":"domain","value":"d', c_custkey, '.example.com"},{"type":"url"}]}') WHEN 1 THEN concat('{"cases":[{"items":[{"value":"v', c_custkey, '","verdict":"clean"}]}]}') ELSE 'no json' END AS raw
"""


@query("""SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'domain' ELSE 'keyword' END AS type, CASE c_custkey % 3 WHEN 0 THEN 'd' || c_custkey || '.example.com' ELSE 'v' || c_custkey END AS value, CASE c_custkey % 3 WHEN 0 THEN 'unknown' ELSE 'clean' END AS verdict FROM customer WHERE c_custkey % 3 < 2""")
def s20_case_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.imported(carrier(spark, sf_dir, "customer", RAW)).select("id", "type", "value", "verdict")


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'no value' ELSE 'no items' END AS problem, 1::BIGINT AS n FROM customer WHERE c_custkey % 3 <> 1")
def s21_e5_import_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.import_problems(carrier(spark, sf_dir, "customer", RAW))


@query("SELECT * FROM (VALUES ('bash', ['shell', 'upload']), ('tar', ['file-read'])) AS t(name, categories)")
def s18_function_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.folded_functions(spark.createDataFrame([('{"executables":{"bash":{"functions":{"upload":"","shell":""}},"tar":{"functions":{"file-read":""}}}}',)], "raw string"))


@query("SELECT count(DISTINCT p_brand) AS names, count(DISTINCT p_brand) >= 50 AS sound FROM part")
def s19_pack_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.plausible_pack(table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")))


@query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'client' WHEN 1 THEN 'public' WHEN 2 THEN 'client' ELSE 'public' END AS mode FROM customer")
def p23_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = carrier(spark, sf_dir, "customer", "c_custkey AS id\nc_custkey % 4 = 0 AS locked\nCASE c_custkey % 4 WHEN 0 THEN 'client' WHEN 2 THEN 'client' END AS policy\nCASE c_custkey % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'public' WHEN 3 THEN 'odd' END AS stored")
    return stores.gate(c).select("id", "mode")


@query("SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'https://a.example.com/x' WHEN 1 THEN 'http://b.example.com' WHEN 2 THEN 'ftp://c.example.com' WHEN 3 THEN 'https://10.0.0.1/' ELSE 'https://nohost' END AS url, CASE c_custkey % 5 WHEN 2 THEN 'scheme' WHEN 3 THEN 'internal' WHEN 4 THEN 'host' END AS refused FROM customer")
def n20_fetch_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = carrier(spark, sf_dir, "customer", "c_custkey AS id\nCASE c_custkey % 5 WHEN 0 THEN ' a[.]example[.]com/x' WHEN 1 THEN 'hxxp://b.example.com' WHEN 2 THEN 'ftp://c.example.com' WHEN 3 THEN 'https://10.0.0.1/' ELSE 'nohost' END AS v")
    a = stores.fetch_address(F.col("v"))
    return c.select("id", a["url"].alias("url"), a["refused"].alias("refused"))


@query("SELECT c_custkey AS id, c_custkey % 4 = 0 AS useful FROM customer")
def p14_useful_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = carrier(spark, sf_dir, "customer", "c_custkey AS id\nCASE c_custkey % 4 WHEN 0 THEN 'https://a.example.com' WHEN 1 THEN ' javascript:x()' WHEN 2 THEN '#top' ELSE 'data:,x' END AS h")
    return c.select("id", stores.useful_link(F.col("h")).alias("useful"))


@query(f"SELECT ord FROM ({_ITEMS_SQL}) WHERE type <> 'attack' AND ord % 2 = 1")
def p15_highlightable(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = _items(spark, sf_dir).withColumn("flags", F.when(F.col("ord") % 2 == 0, F.array(F.lit("non-routable:private"))).otherwise(F.array().cast("array<string>")))
    return stores.highlightable(flagged).select("ord")


LINES = "c_nationkey AS doc_id\nc_custkey AS pos\nCASE c_custkey % 5 WHEN 0 THEN md5(concat('', c_custkey)) WHEN 1 THEN concat(' ', sha1(concat('', c_custkey)), ' ') WHEN 2 THEN ' ' WHEN 3 THEN 'a,b,c' ELSE concat('t', c_custkey) END AS line"


@query(f"SELECT doc_id, CAST(length(trim(line)) AS INTEGER) AS length, count(*) AS n FROM ({select('customer', LINES)}) WHERE regexp_full_match(trim(line), '[0-9a-f]{{8,}}') GROUP BY ALL")
def a15_n8_hex_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.census(carrier(spark, sf_dir, "customer", LINES))


@query(f"SELECT doc_id, pos, last_value(CASE WHEN trim(line) <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM ({select('customer', LINES)})")
def w6_line_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.line_above(carrier(spark, sf_dir, "customer", LINES)).select("doc_id", "pos", "above")


@query(f"SELECT doc_id, pos, coalesce(line = 'a,b,c' AND lead(line) OVER (PARTITION BY doc_id ORDER BY pos) = 'a,b,c', false) AS record FROM ({select('customer', LINES)})")
def n10_record_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.record_pairs(carrier(spark, sf_dir, "customer", LINES)).select("doc_id", "pos", "record")


@query("SELECT event_type AS feature, CAST(DATE '2024-03-15' - max(ts)::DATE AS INTEGER) AS idle_days FROM events WHERE event_type <> 'click' GROUP BY 1 HAVING DATE '2024-03-15' - max(ts)::DATE >= 30")
def a14_unused_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("feature")).agg(F.max("ts").alias("last"))
    return stores.unused(usage, F.lit("2024-03-15").cast("date"), ["click"])


@query("SELECT * FROM (VALUES ('T1002', 'Technique 2'), ('T1002.001', 'Technique 2.001'), ('T1005', 'Technique 5'), ('T1005.001', 'Technique 5.001'), ('T1008', 'Technique 8'), ('T1008.001', 'Technique 8.001'), ('T1011', 'Technique 11'), ('T1011.001', 'Technique 11.001')) AS t(id, name)")
def j19_tactic_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.tactic_techniques(_techniques(spark), "Discovery")


@query("SELECT 'T' || (1000 + k) || s AS id FROM (VALUES (1), (4), (7), (10), (13)) AS a(k), (VALUES (''), ('.001')) AS b(s)")
def p22_matrix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.matching(_techniques(spark), tactic="persistence").select("id")


@query(f"""WITH e AS (SELECT case_id, lower(value) AS "from", CASE WHEN source <> '' THEN 's:' || source END AS "to" FROM ({select("customer", CASE_ITEMS)})), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY "to" IS NULL, "to", "from") AS r FROM e)
    SELECT case_id, count(*) FILTER (r <= 20) AS shown, count(*) FILTER (r > 20) AS more FROM r GROUP BY case_id""")
def l9_capped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = carrier(spark, sf_dir, "customer", CASE_ITEMS).select("case_id", F.lower("value").alias("from"), F.when(F.col("source") != "", F.concat(F.lit("s:"), "source")).alias("to"))
    return stores.capped_rows(i, 20).groupBy("case_id").agg(F.count("from").alias("shown"), F.coalesce(F.max("more"), F.lit(0)).alias("more"))


@query(f"SELECT case_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY t DESC) AS r FROM (SELECT user_id AS case_id, event_id AS ord, ts AS t FROM events)) WHERE r <= 3")
def l8_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.newest(carrier(spark, sf_dir, "events", "user_id AS case_id\nevent_id AS ord\nts AS t"), ["case_id"], "t", 3).select("case_id", "ord")


@query()
def k5_case_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.case_json(_items(spark, sf_dir), carrier(spark, sf_dir, "events", "user_id % 6 AS case_id\nts AS t\nevent_type AS kind"))


@query(f"""WITH i AS (SELECT case_id, ord, value, coalesce(verdict, 'unknown') AS v FROM ({_ITEMS_SQL})), r AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY case_id, v) AS n, CASE v WHEN 'unknown' THEN 30 WHEN 'malicious' THEN 20 WHEN 'suspicious' THEN 20 ELSE 0 END AS cap FROM i WINDOW w AS (PARTITION BY case_id, v ORDER BY ord)),
    p AS (SELECT case_id, v, v || ': ' || first(n) || CASE WHEN first(cap) > 0 THEN chr(10) || string_agg('  - ' || value, chr(10) ORDER BY r) FILTER (r <= cap) || CASE WHEN first(n) > first(cap) THEN chr(10) || '  - … and ' || (first(n) - first(cap)) || ' more' ELSE '' END ELSE '' END AS p FROM r GROUP BY case_id, v)
    SELECT case_id, string_agg(p, chr(10) ORDER BY list_position(['malicious', 'suspicious', 'clean', 'irrelevant', 'unknown'], v)) AS text FROM p GROUP BY case_id""")
def k13_handover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.handover(_items(spark, sf_dir))


@query(f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY t, ord) AS r FROM ({_EVENTS_SQL})), d AS (SELECT case_id, strftime(t, '%d.%m.%Y') AS day, min(r) AS r, string_agg('- `' || strftime(t, '%H:%M') || '` ' || kind, chr(10) ORDER BY r) AS l FROM e WHERE r <= 200 GROUP BY ALL)
    SELECT case_id, string_agg('**' || day || '**' || chr(10) || chr(10) || l, chr(10) || chr(10) ORDER BY r) AS text FROM d GROUP BY case_id""")
def k14_log_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.log_markdown(carrier(spark, sf_dir, "events", EVENTS))


@query("SELECT c_custkey AS id, 'https://search.example.org/search?q=a%20b' || c_custkey || '&time_range=week' AS url FROM customer")
def f19_search_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carrier(spark, sf_dir, "customer", "c_custkey AS id\nconcat('a b', c_custkey) AS q").select("id", stores.search_address("https://search.example.org/", F.col("q"), "week").alias("url"))


@query("SELECT c_custkey AS id, unnest(['https://web.archive.org/web/*/', 'https://archive.ph/', 'https://web.archive.org/save/']) || 'https://e.example.com/' || c_custkey AS url FROM customer")
def f22_archive_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = carrier(spark, sf_dir, "customer", "c_custkey AS id\nconcat('https://e.example.com/', c_custkey) AS u")
    return c.select("id", F.explode(facts.archive_links(F.col("u"))).alias("url"))


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'd.example.com' WHEN 1 THEN 'h.example.com' ELSE 'm.example.org' END AS host FROM customer")
def f26_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = carrier(spark, sf_dir, "customer", "c_custkey AS id\nCASE c_custkey % 3 WHEN 0 THEN 'domain' WHEN 1 THEN 'url' ELSE 'email' END AS type\nCASE c_custkey % 3 WHEN 0 THEN ' D.example.com' WHEN 1 THEN 'https://u@H.example.com:8/x' ELSE 'u@M.example.org' END AS value")
    return c.select("id", T.host_of("type", "value").alias("host"))


@query("SELECT c_custkey AS id, 'Boss, Big' AS display, 'a' || c_custkey || '@Mail.example.org' AS address, 'mail.example.org' AS domain FROM customer")
def n14_mail_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = carrier(spark, sf_dir, "customer", "c_custkey AS id\nconcat('\"Boss, Big\" <a', c_custkey, '@Mail.example.org>') AS v")
    a = mail.address(F.col("v"))
    return c.select("id", a["display"].alias("display"), a["address"].alias("address"), a["domain"].alias("domain"))


@query("SELECT c_custkey AS id, c_custkey % 4 IN (0, 1) AS noisy FROM customer")
def p18_noisy_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = carrier(spark, sf_dir, "customer", "c_custkey AS id\nCASE c_custkey % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/css' WHEN 2 THEN 'text/html' ELSE 'application/json' END AS t")
    return c.select("id", F.col("t").rlike(har.NOISY).alias("noisy"))


@query("SELECT * FROM (VALUES ('net', 1), ('hash', 2), ('pub', 3), ('scan', 4)) AS t(id, place)")
def l11_tool_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rank = F.array_position(F.array(*map(F.lit, ("internal", "limited", "public"))), F.col("exposure"))
    return _tools(spark).select("id", F.row_number().over(Window.orderBy(rank, "name")).alias("place"))  # a registry of a few hundred rows


@query("SELECT * FROM (VALUES ('scan', 100), ('hash', 0), ('net', 0), ('pub', 0)) AS t(id, score)")
def l3_l4_tool_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tools(spark).select("id", facts.tool_score(F.col("name"), F.lit(""), "scan").alias("score"))


@query(f"SELECT c_custkey AS id, c_custkey % 6 >= 4 AS known FROM customer")
def j20_known_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = carrier(spark, sf_dir, "customer", HOSTS).select("id", T.url_host("url").alias("host"))
    known = spark.createDataFrame([("example.com",)], "base string")
    hit = hosts.select("host").distinct().select("host", F.explode(noise.suffixes(F.col("host"))).alias("base")).join(known, "base").select("host").distinct().withColumn("known", F.lit(True))
    return hosts.join(hit, "host", "left").select("id", F.coalesce("known", F.lit(False)).alias("known"))


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'example.com' WHEN 1 THEN '' ELSE 'a.b' END AS domain FROM customer")
def n19_normal_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import ranges

    c = carrier(spark, sf_dir, "customer", "c_custkey AS id\nCASE c_custkey % 3 WHEN 0 THEN ' .Example.COM. ' WHEN 1 THEN 'не.latin' ELSE 'a.b' END AS d")
    return c.select("id", ranges.normal_domain(F.col("d")).alias("domain"))


@query("SELECT c_custkey AS id, c_custkey % 2 = 0 OR c_custkey % 3 <> 0 AS sendable FROM customer")
def p10_sendable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import ranges

    c = carrier(spark, sf_dir, "customer", "c_custkey AS id\nCASE c_custkey % 2 WHEN 0 THEN 'internal' ELSE 'public' END AS exposure\nCASE WHEN c_custkey % 3 = 0 THEN 'policy' END AS own")
    return c.select("id", ranges.sendable("exposure", F.col("own")).alias("sendable"))

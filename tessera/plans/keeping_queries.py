"""Queries over catalogue files, rule assembly, reports on techniques, and stores that change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import attack, exports, facts, keeping
from ..sources import files
from .case_queries import _CASE, _ITEMS_SQL, _items, _techniques
from .registry import carrier, query, select, table

CATALOGUES = """
n_nationkey AS id
concat('{"techniques":{"T', 1000 + n_nationkey, '":["Name ', n_nationkey, '",[', n_nationkey % 3, '],1],"T', 1000 + n_nationkey, '.001":["Part ', n_nationkey, '",[0,', n_nationkey % 3, ']]', CASE WHEN n_nationkey % 2 = 0 THEN ',"T9000":["Bare"]' ELSE '' END, '},"tactics":["execution","discovery","impact"]', CASE WHEN n_nationkey % 4 = 0 THEN ',"attack":{"версия":"19.2"}' ELSE '' END, '}') AS raw
"""


@query("""WITH n AS (SELECT n_nationkey AS k, ['execution', 'discovery', 'impact'][n_nationkey % 3 + 1] AS t FROM nation)
    SELECT 'T' || (1000 + k) AS id, 'Name ' || k AS name, [t] AS tactics FROM n UNION ALL SELECT 'T' || (1000 + k) || '.001', 'Part ' || k, ['execution', t] FROM n UNION ALL SELECT 'T9000', 'Bare', [] FROM n WHERE k % 2 = 0""")
def s16_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attack.catalogue_of(carrier(spark, sf_dir, "nation", CATALOGUES))


@query("SELECT CAST(2 + (n_nationkey % 2 = 0)::INTEGER AS INTEGER) AS entries, 3 AS tactics, CASE WHEN n_nationkey % 4 = 0 THEN '19.2' END AS version, CAST(NULL AS VARCHAR) AS built FROM nation")
def a16_catalogue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attack.catalogue_summary(carrier(spark, sf_dir, "nation", CATALOGUES))


@query(f"""WITH {_CASE}, a AS (SELECT i.ord, i.value, c.name AS own, c.tactics, p.name AS parent, string_split(i.value, '.')[1] AS base FROM i LEFT JOIN c ON c.id = i.value LEFT JOIN c AS p ON i.value LIKE '%.%' AND p.id = string_split(i.value, '.')[1] WHERE i.type = 'attack')
    SELECT ord, 'technique' AS name, own AS value FROM a WHERE own IS NOT NULL UNION ALL SELECT ord, 'tactics', array_to_string(tactics, ', ') FROM a WHERE own IS NOT NULL
    UNION ALL SELECT ord, 'parent', base || ' — ' || parent FROM a WHERE own IS NOT NULL AND parent IS NOT NULL UNION ALL SELECT ord, 'warning', 'no such technique' FROM a WHERE own IS NULL""")
def f13_technique_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attack.technique_facts(_items(spark, sf_dir).filter("type = 'attack'").select("ord", F.col("value").alias("technique")), _techniques(spark), "technique").select("ord", "name", "value")


_TACTICS = ["persistence", "execution", "discovery"]


@query(f"""WITH {_CASE}, f AS (SELECT case_id, value AS id, coalesce(list(verdict ORDER BY ord)[1], 'unknown') AS v, coalesce(nullif(arg_min(verdict_source, ord), ''), '—') AS s, coalesce(nullif(arg_min(note, ord), ''), '—') AS o FROM i WHERE type = 'attack' GROUP BY ALL),
    j AS (SELECT f.*, c.name, c.tactics FROM f LEFT JOIN c USING (id)), t AS (SELECT *, unnest(tactics) AS tactic FROM j WHERE name IS NOT NULL), p AS (SELECT *, list_position(['persistence', 'execution', 'discovery'], tactic) AS pl FROM t),
    h AS (SELECT case_id, '> Techniques in the case: **' || count(*) || '**' || CASE WHEN count(name) <> count(*) THEN ' (in the catalogue: ' || count(name) || ')' ELSE '' END || '. '
        || array_to_string(list_filter([{", ".join(f"CASE WHEN count_if(v = '{x}') > 0 THEN '{x}: ' || count_if(v = '{x}') END" for x in attack.VERDICTS)}], lambda x: x IS NOT NULL), ' · ') || '.'
        || CASE WHEN count_if(v = 'unknown') > 0 THEN chr(10) || '>' || chr(10) || '> **Not checked: ' || count_if(v = 'unknown') || '**' ELSE '' END AS head,
        coalesce(chr(10) || chr(10) || '> Not in the catalogue: ' || string_agg('`' || id || '`', ', ' ORDER BY id) FILTER (name IS NULL), '') AS tail FROM j GROUP BY case_id),
    b AS (SELECT case_id, pl, '| ' || tactic || ' | ' || count(*) || ' | ' || count_if(v = 'malicious') || ' | ' || count_if(v = 'suspicious') || ' | ' || count_if(v = 'unknown') || ' |' AS l FROM p GROUP BY case_id, pl, tactic),
    s AS (SELECT case_id, string_agg(l, chr(10) ORDER BY pl) AS sums FROM b GROUP BY case_id),
    d AS (SELECT case_id, string_agg('| ' || tactic || ' | `' || id || '` | [' || name || '](https://attack.mitre.org/techniques/' || replace(id, '.', '/') || '/) | ' || v || ' | ' || s || ' | ' || o || ' |', chr(10) ORDER BY pl, id) AS details FROM p GROUP BY case_id)
    SELECT h.case_id, head || coalesce(chr(10) || chr(10) || '| Tactic | Techniques | Malicious | Suspicious | Not checked |' || chr(10) || '|---|---:|---:|---:|---:|' || chr(10) || sums || chr(10) || chr(10)
        || '| Tactic | ID | Technique | Verdict | Checked with | Observation |' || chr(10) || '|---|---|---|---|---|---|' || chr(10) || details, '') || tail AS text FROM h LEFT JOIN s USING (case_id) LEFT JOIN d USING (case_id)""")
def k15_coverage_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attack.coverage_markdown(_items(spark, sf_dir), _techniques(spark), _TACTICS)


@query(f"""WITH i AS ({_ITEMS_SQL}), o AS (SELECT * FROM i WHERE coalesce(verdict, '') NOT IN ('clean', 'irrelevant')), k AS (SELECT *, type NOT IN ('cve', 'tgchan', 'attack') AS known, ord % 11 = 0 AS own FROM o),
    t AS (SELECT case_id, type, known, count_if(NOT own) AS n, count_if(own AND known) AS own FROM k GROUP BY ALL),
    p AS (SELECT case_id, sum(own) AS own, sum(CASE WHEN known THEN greatest(n - 5, 0) ELSE 0 END) AS extra, coalesce(list(type || ': ' || n || ' values, no rule is made of this type' ORDER BY type) FILTER (NOT known AND n > 0), []) AS types FROM t GROUP BY case_id),
    r AS (SELECT case_id, count_if(type NOT IN ('email')) > 0 AS sigma, count_if(type IN ('domain', 'url', 'ipv4')) > 0 AS suricata, count_if(type <> 'ipv4') > 0 AS yara FROM k WHERE known AND NOT own GROUP BY case_id)
    SELECT c.case_id, coalesce(sigma, false) AS sigma, coalesce(suricata, false) AS suricata, coalesce(yara, false) AS yara, CASE WHEN r.case_id IS NULL THEN ['no indicator of the case can be in a rule; cleared and irrelevant ones are left out on purpose']
        ELSE list_filter(list_concat([CASE WHEN own > 0 THEN own || ' own values are left out' END, CASE WHEN extra > 0 THEN extra || ' values are left out: at most 5 of a type' END], types,
            [CASE WHEN NOT sigma THEN 'sigma: nothing to put in a rule' END, CASE WHEN NOT suricata THEN 'suricata: nothing to put in a rule' END, CASE WHEN NOT yara THEN 'yara: nothing to put in a rule' END]), lambda x: x IS NOT NULL) END AS notes
    FROM (SELECT DISTINCT case_id FROM i) AS c LEFT JOIN p USING (case_id) LEFT JOIN r ON r.case_id = c.case_id""")
def k10_rule_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.assembled(_items(spark, sf_dir), 5).select("case_id", *[F.col(c).isNotNull().alias(c) for c in ("sigma", "suricata", "yara")], "notes")


@query("""SELECT p_partkey AS id, template, replace(t, '{{q}}', trim(p_name)) AS search FROM part, (VALUES ('exact', '"{{q}}"'), ('filetype', '{{q}} filetype:pdf'), ('ioc-list', '{{q}} (filetype:csv OR filetype:txt OR filetype:json)'), ('title', 'intitle:"{{q}}"'), ('url', 'inurl:{{q}}'), ('github', 'site:github.com {{q}}'),
    ('paste', '(site:pastebin.com OR site:ghostbin.com OR site:rentry.co) {{q}}'), ('recent', '{{q}} (site:x.com OR site:infosec.exchange OR site:reddit.com)'), ('no-noise', '{{q}} -site:virustotal.com -site:abuseipdb.com -site:pulsedive.com')) AS d(template, t) WHERE p_partkey % 5 <> 0""")
def f20_search_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit(" "), "p_name")).otherwise("  ").alias("text"))
    return facts.templated(rows).select("id", "template", "search")


@query("SELECT count(*) AS n, count(*) AS kinds, count(*) AS sound FROM customer")
def f25_uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = carrier(spark, sf_dir, "customer", "c_custkey AS id").select(facts.name_uuid(F.lit("case"), F.col("id")).alias("u"))
    return u.agg(F.count("*").alias("n"), F.count_distinct("u").alias("kinds"), F.count_if(F.col("u").rlike(r"\A[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z")).alias("sound"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '--:--' ELSE strftime(ts, '%H:%M') END AS clock, CASE WHEN event_id % 7 = 0 THEN 'unknown date' ELSE strftime(ts, '%d.%m.%Y') END AS day FROM events")
def f23_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("event_id") % 7 == 0, "never").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", facts.clock(t).alias("clock"), facts.day(t).alias("day"))


SHELLS = """
c_custkey AS page_id
CASE c_custkey % 4 WHEN 0 THEN '<p>plain</p>' WHEN 1 THEN concat('<script type="application/json">{"a":"short","b":["', repeat('x', 80), c_custkey, '",{"c":"', repeat('<b>y</b>', 20), '"}]}</script>') WHEN 2 THEN concat('<script type="application/json">{"broken</script><SCRIPT id=x type=''application/ld+json'' async>["', repeat('z', 90), '","', repeat('z', 90), '"]</SCRIPT>') ELSE concat('<script>["', repeat('q', 90), '"]</script>') END AS html
"""


@query("SELECT c_custkey AS page_id, CASE c_custkey % 4 WHEN 1 THEN repeat(' y ', 20) || chr(10) || repeat('x', 80) || c_custkey WHEN 2 THEN repeat('z', 90) ELSE '' END AS text FROM customer")
def s11_embedded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.embedded_text(carrier(spark, sf_dir, "customer", SHELLS))


CASES = """
c_nationkey AS store_id
c_custkey AS ord
concat('c', c_custkey) AS id
concat('Case ', c_custkey) AS title
CASE WHEN c_custkey % 2 = 0 THEN 'amber' ELSE 'clear' END AS tlp
"""
_STORES = f"s AS (SELECT store_id, ord, id, title, tlp, ord = min(ord) OVER (PARTITION BY store_id) AS active FROM ({select('customer', CASES)}))"


def _stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = carrier(spark, sf_dir, "customer", CASES)
    return rows.withColumn("active", F.col("ord") == F.min("ord").over(Window.partitionBy("store_id")))


@query(f"""WITH {_STORES}, l AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY ord) = 1 AS first FROM s WHERE ord % 3 <> 0), w AS (SELECT store_id FROM s WHERE active AND ord % 3 = 0)
    SELECT store_id, id, active OR (first AND store_id IN (SELECT store_id FROM w)) AS active FROM l""")
def e4_removed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _stores(spark, sf_dir)
    return keeping.removed_cases(cases, cases.filter("ord % 3 = 0")).select("store_id", "id", "active")


@query(f"""WITH {_STORES}, n AS (SELECT DISTINCT store_id FROM s WHERE store_id % 2 = 0), a AS (SELECT store_id, ord, id, active AND store_id % 2 <> 0 AS active FROM s UNION ALL SELECT store_id, (SELECT max(ord) + 1 FROM s AS x WHERE x.store_id = n.store_id), 'new', true FROM n)
    SELECT store_id, ord, id, active FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY ord DESC) AS r FROM a) WHERE r <= 4""")
def e4_added_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _stores(spark, sf_dir)
    new = cases.filter("store_id % 2 = 0").select("store_id").distinct().select("store_id", F.lit("new").alias("id"), F.lit("").alias("title"), F.lit("clear").alias("tlp"))
    return keeping.added_cases(cases, new, 4).select("store_id", "ord", "id", "active")


@query(f"""WITH {_STORES}, x AS (SELECT store_id, CASE WHEN store_id % 2 = 0 THEN arg_max(id, ord) ELSE 'none' END AS chosen FROM s GROUP BY store_id)
    SELECT store_id, id, CASE WHEN store_id % 2 = 0 THEN id = chosen ELSE active END AS active, CASE WHEN ord % 5 = 0 THEN 'New ' || ord ELSE title END AS title, CASE WHEN ord % 10 = 5 THEN 'red' ELSE tlp END AS tlp FROM s JOIN x USING (store_id)""")
def e4_active_and_updated_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _stores(spark, sf_dir)
    chosen = cases.groupBy("store_id").agg(F.when(F.col("store_id") % 2 == 0, F.max_by("id", "ord")).otherwise("none").alias("id"))
    patches = cases.filter("ord % 5 = 0").select("store_id", "id", F.concat(F.lit(" New "), F.col("ord").cast("string")).alias("title"), F.when(F.col("ord") % 10 == 5, "red").otherwise("").alias("tlp"))
    return keeping.updated_cases(keeping.activated(cases, chosen), patches).select("store_id", "id", "active", "title", "tlp")


FILTERS = """
c_nationkey AS profile
c_custkey AS case_id
CASE WHEN c_custkey % 2 = 0 THEN 'execution' END AS tactic
'linux' AS platform
concat('m', c_custkey, '.png') AS png
c_custkey * 10 AS updated
"""


@query(f"""WITH f AS ({select("customer", FILTERS)}), w AS (SELECT profile, case_id, CASE WHEN case_id % 3 = 0 THEN 'impact' ELSE tactic END AS tactic, CASE WHEN case_id % 6 = 0 THEN '' ELSE png END AS png, CASE WHEN case_id % 3 = 0 THEN updated + 100000 ELSE updated END AS updated FROM f),
    r AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY updated DESC, case_id) AS r FROM w) SELECT profile, case_id, tactic, png, updated FROM r WHERE r <= 5 AND case_id % 4 <> 0""")
def e6_case_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = carrier(spark, sf_dir, "customer", FILTERS)
    new = stored.filter("case_id % 3 = 0").withColumn("tactic", F.lit("impact")).withColumn("png", F.when(F.col("case_id") % 6 == 0, F.lit(""))).withColumn("updated", F.col("updated") + 100000)
    kept = keeping.written_filters(stored, new, 5)
    return keeping.pruned_filters(kept, stored.filter("case_id % 4 <> 0")).select("profile", "case_id", "tactic", "png", "updated")


QUEUES = """
c_custkey AS id
CASE c_custkey % 4 WHEN 0 THEN concat('{"items":[{"type":"domain","value":"d', c_custkey, '.example.com","count":', c_custkey % 3, ',"flags":["port"]},{"type":"url"},{"value":"x"}],"dismissed":[{"k":"url|u', c_custkey, '"},{"t":"2024-01-01"}]}') WHEN 1 THEN concat('{"items":[{"type":"ipv4","typeLabel":"Address","value":"203.0.113.', c_custkey % 256, '","source":"s","seenAt":"2024-02-02T00:00:00Z"}]}') WHEN 2 THEN 'broken' ELSE '{"items":"none"}' END AS raw
"""


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'domain' ELSE 'ipv4' END AS type, CASE c_custkey % 4 WHEN 0 THEN 'domain' ELSE 'Address' END AS label, CASE c_custkey % 4 WHEN 0 THEN 'd' || c_custkey || '.example.com' ELSE '203.0.113.' || (c_custkey % 256) END AS value,
    CASE c_custkey % 4 WHEN 0 THEN ['port'] ELSE [] END AS flags, CASE c_custkey % 4 WHEN 0 THEN '' ELSE 's' END AS source, CASE c_custkey % 4 WHEN 0 THEN '1970-01-01T00:00:00.000Z' ELSE '2024-02-02T00:00:00Z' END AS seen, CAST(CASE c_custkey % 4 WHEN 0 THEN greatest(1, c_custkey % 3) ELSE 1 END AS BIGINT) AS n FROM customer WHERE c_custkey % 4 < 2""")
def s22_triage_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keeping.triage_queue(carrier(spark, sf_dir, "customer", QUEUES)).drop("ord")


@query("SELECT c_custkey AS id, 'url|u' || c_custkey AS key, '1970-01-01T00:00:00.000Z' AS t FROM customer WHERE c_custkey % 4 = 0")
def s22_dismissed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keeping.dismissed_values(carrier(spark, sf_dir, "customer", QUEUES))


LISTS = """
c_custkey AS id
CASE c_custkey % 6 WHEN 0 THEN concat('{"версия":2,"набор":{"name":" N', c_custkey, ' ","steps":["a"," b ","a",""]}}') WHEN 1 THEN '{"версия":1,"свои":[{"id":"other","name":"O","steps":["x"]},{"id":"мои-проверки","name":"","steps":["y","z"]}]}' WHEN 2 THEN '{"свои":[{"id":"first","name":"F","steps":["x"]}]}' WHEN 3 THEN '[1]' WHEN 4 THEN '{"версия":3,"набор":{"name":"later","steps":[]}}' END AS raw
"""


@query("""SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'N' || c_custkey WHEN 1 THEN 'Мои проверки' WHEN 2 THEN 'F' WHEN 4 THEN 'later' ELSE '' END AS name, CASE c_custkey % 6 WHEN 0 THEN ['a', 'b'] WHEN 1 THEN ['y', 'z'] WHEN 2 THEN ['x'] ELSE [] END AS steps, c_custkey % 6 < 3 AS configured,
    CASE c_custkey % 6 WHEN 1 THEN ['other lists dropped: 1'] WHEN 3 THEN ['unreadable: an empty list is taken'] WHEN 4 THEN ['a newer version: unknown fields are dropped'] ELSE [] END AS notes FROM customer""")
def s22_e9_check_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keeping.check_list(carrier(spark, sf_dir, "customer", LISTS))


@query("""SELECT c_custkey AS id, 'N' || c_custkey AS name, ['a', 'b'] AS steps FROM customer""")
def e9_saved_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = carrier(spark, sf_dir, "customer", "c_custkey AS id").select("id", keeping.saved_list(F.concat(F.lit(" N"), F.col("id").cast("string")), F.array(F.lit("a"), F.lit(" b"), F.lit("a"), F.lit(" "))).alias("raw"))
    return keeping.check_list(rows).select("id", "name", "steps")


@query("SELECT n_regionkey AS profile, n_name AS site, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 3 = 0, n_nationkey) AS INTEGER) AS place FROM nation")
def l6_site_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = carrier(spark, sf_dir, "nation", "n_regionkey AS profile\nn_nationkey AS ord\nn_name AS site\nn_nationkey % 3 = 0 AS russian")
    return keeping.ordered_sites(rows, "en").select("profile", "site", "place")


@query("SELECT c_custkey AS id, 'capturing this tab · pages ' || (c_custkey % 9) || ' · queued ' || (c_custkey % 4) AS now, 'capture stopped (by the user): pages ' || (c_custkey % 9) || ', found 0, queued ' || (c_custkey % 4) AS \"end\" FROM customer")
def t7_capture_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keeping.capture_status(carrier(spark, sf_dir, "customer", "c_custkey AS id\nc_custkey % 9 AS pages\nCAST(NULL AS BIGINT) AS found\nc_custkey % 4 AS added"))


@query("SELECT c_nationkey AS har_id, count(*) || ' entries have no server address' AS problem FROM customer WHERE c_custkey % 3 = 0 GROUP BY c_nationkey")
def a17_without_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keeping.without_address(carrier(spark, sf_dir, "customer", "c_nationkey AS har_id\nCASE c_custkey % 3 WHEN 0 THEN CASE WHEN c_custkey % 2 = 0 THEN '' END ELSE '203.0.113.1' END AS ip"))

"""Queries over cases: archives, event logs, triage, techniques, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attack, exports, timeline
from ..sources import har
from .registry import carrier, query, select, table

_ENTRY = """concat('{"startedDateTime":"2024-01-0', {n}, 'T00:00:00Z","time":', {n}, '.4,"serverIPAddress":"[203.0.113.', c_custkey % {m}, ']","request":{"method":"get","url":"https://h', (c_custkey + {n}) % 5, '.example.com/p', {n}, '","headers":[{"name":"Cookie","value":"secret"},{"name":"Referer","value":"https://ref.example.org/"}]},"response":{"status":', {s}, ',"headers":[{"name":"Location","value":"/next', {n}, '"}],"content":{"mimeType":"', {t}, '; charset=utf-8","size":', c_custkey, '}}}')"""


def _entry(n: int, m: int, s: str, t: str) -> str:
    return _ENTRY.replace("{n}", str(n)).replace("{m}", str(m)).replace("{s}", s).replace("{t}", t)


HARS = f"""
c_custkey AS har_id
concat('{{"log":{{"version":"1.2","entries":[', {_entry(1, 7, "CASE WHEN c_custkey % 2 = 0 THEN 302 ELSE 200 END", "'text/html'")}, ',', {_entry(2, 3, "200", "'image/png'")}, ',', {_entry(3, 7, "404", "'application/json'")}, ']}}}}') AS raw
"""
_E = """WITH c AS (SELECT c_custkey AS k FROM customer), e AS (SELECT k AS har_id, n, 'h' || ((k + n) % 5) || '.example.com' AS host, '203.0.113.' || (k % CASE n WHEN 2 THEN 3 ELSE 7 END) AS ip,
    CASE WHEN n = 1 THEN CASE WHEN k % 2 = 0 THEN 302 ELSE 200 END WHEN n = 2 THEN 200 ELSE 404 END AS status, n = 2 AS noisy FROM c, (VALUES (1), (2), (3)) AS t(n))"""


@query(_E + """ SELECT har_id, CAST(n AS INTEGER) AS n, 'GET' AS method, host, ip, status, noisy, CASE WHEN status = 302 THEN 'https://' || host || '/next1' ELSE '' END AS redirect, 'https://ref.example.org/' AS referer, CAST(n AS BIGINT) AS ms FROM e""")
def s7_s8_har_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return har.entries(carrier(spark, sf_dir, "customer", HARS)).select("har_id", "n", "method", "host", "ip", "status", "noisy", "redirect", "referer", "ms")


@query(_E + " SELECT har_id, host, count(*) AS requests, list_sort(list_distinct(list(ip))) AS ips, bool_and(noisy) AS noisy FROM e GROUP BY ALL")
def a1_har_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return har.hosts(har.entries(carrier(spark, sf_dir, "customer", HARS))).select("har_id", "host", "requests", "ips", "noisy")


@query(_E + " SELECT har_id, ip, count(*) AS requests, list_sort(list_distinct(list(host))) AS hosts FROM e GROUP BY ALL")
def a2_har_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return har.addresses(har.entries(carrier(spark, sf_dir, "customer", HARS)))


@query(_E + " SELECT har_id, count(*) AS entries, count_if(noisy)::BIGINT AS noisy, count(DISTINCT host) AS hosts, count(DISTINCT ip) AS addresses, '2024-01-01T00:00:00Z' AS first, '2024-01-03T00:00:00Z' AS last, 0::BIGINT AS without_ip FROM e GROUP BY har_id")
def a3_har_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return har.summary(har.entries(carrier(spark, sf_dir, "customer", HARS)))


@query(_E + """ SELECT har_id, string_agg('URL: https://' || host || '/p' || n || chr(10) || 'Server-IP: ' || ip || chr(10) || 'Referer: https://ref.example.org/' || chr(10) || 'Location: /next' || n, chr(10) ORDER BY n) AS text FROM e WHERE NOT noisy GROUP BY har_id""")
def k19_har_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return har.text(har.entries(carrier(spark, sf_dir, "customer", HARS)))


EVENTS = """
user_id AS case_id
event_id AS ord
ts AS t
CASE event_type WHEN 'purchase' THEN 'export.done' WHEN 'signup' THEN 'case.started' WHEN 'view' THEN 'ioc.added' WHEN 'click' THEN 'verdict.set' ELSE 'note.set' END AS kind
concat('v', event_id % 2) AS value
concat('s', event_id % 2) AS source
event_id % 5 AS count
CASE WHEN event_id % 3 = 0 THEN 'clean' ELSE 'unknown' END AS from
CASE WHEN event_id % 2 = 0 THEN 'malicious' ELSE 'clean' END AS to
"""
_EVENTS_SQL = select("events", EVENTS).replace(" AS from", ' AS "from"').replace(" AS to", ' AS "to"')


@query(f"""SELECT case_id, count(*) AS events, 0::BIGINT AS sources, coalesce(sum(count) FILTER (kind = 'ioc.added'), 0)::BIGINT AS added, count_if(kind = 'verdict.set')::BIGINT AS verdicts, 0::BIGINT AS playbooks, 0::BIGINT AS opened,
    count_if(kind = 'export.done')::BIGINT AS exports, min(t) AS first, max(t) AS last FROM ({_EVENTS_SQL}) GROUP BY case_id""")
def a6_work_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.work(carrier(spark, sf_dir, "events", EVENTS))


@query(f"""WITH e AS ({_EVENTS_SQL}), x AS (SELECT case_id, max(t) AS exported FROM e WHERE kind = 'export.done' GROUP BY case_id),
    c AS (SELECT e.case_id, count(*) AS changes, min(t) AS since FROM e LEFT JOIN x USING (case_id) WHERE kind IN ('case.started', 'ioc.added', 'verdict.set', 'note.set') AND (exported IS NULL OR t > exported) GROUP BY e.case_id),
    a AS (SELECT DISTINCT case_id FROM e), r AS (SELECT a.case_id, exported, coalesce(changes, 0) AS changes, greatest(0, (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(since)) / 3.6e9) AS hours FROM a LEFT JOIN x USING (case_id) LEFT JOIN c USING (case_id))
    SELECT case_id, changes, coalesce(changes > 0 AND (hours >= 2 OR changes >= 20), false) AS remind, coalesce(changes > 0 AND (hours >= 2 OR changes >= 20) AND (hours >= 24 OR changes >= 50), false) AS urgent FROM r""")
def a10_unsaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.unsaved(carrier(spark, sf_dir, "events", EVENTS), F.lit("2024-02-01 00:00:00").cast("timestamp")).select("case_id", "changes", "remind", "urgent")


@query(f"""WITH e AS ({_EVENTS_SQL}), k AS (SELECT *, CASE WHEN kind IN ('ioc.added', 'verdict.set', 'note.set') THEN kind || chr(31) || CASE WHEN kind = 'ioc.added' THEN source ELSE value END END AS key FROM e),
    l AS (SELECT *, lag(key) OVER w AS pk, lag(t) OVER w AS pt FROM k WINDOW w AS (PARTITION BY case_id ORDER BY t, ord)),
    n AS (SELECT *, sum(CASE WHEN key = pk AND epoch_us(t) - epoch_us(pt) <= 120000000 THEN 0 ELSE 1 END) OVER (PARTITION BY case_id ORDER BY t, ord) AS run FROM l)
    SELECT case_id, max(t) AS t, first(kind) AS kind, CASE WHEN first(kind) = 'ioc.added' THEN sum(count) ELSE arg_max(count, ord) END::BIGINT AS count FROM n GROUP BY case_id, run""")
def w3_merged_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.merged(carrier(spark, sf_dir, "events", EVENTS)).select("case_id", "t", "kind", "count")


@query(f"""WITH e AS ({_EVENTS_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY t DESC, ord DESC) AS r, count(*) OVER (PARTITION BY case_id) AS total FROM e)
    SELECT case_id, t, kind, NULL::BIGINT AS n FROM r WHERE total <= 40 OR r <= 39 UNION ALL SELECT case_id, min(t), 'timeline.truncated', first(total) - 39 FROM r WHERE total > 40 AND r <= 39 GROUP BY case_id""")
def w4_capped_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.capped(carrier(spark, sf_dir, "events", EVENTS), 40)


@query(f"SELECT case_id, CAST(t AS DATE) AS day, count(*) AS events FROM ({_EVENTS_SQL}) GROUP BY ALL")
def w5_t5_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.by_day(carrier(spark, sf_dir, "events", EVENTS))


@query()
def w3_folded_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.folded(carrier(spark, sf_dir, "events", EVENTS))


FINDS = """
user_id % 7 AS queue
event_id AS ord
event_type AS type
concat('V', user_id) AS value
ts AS seen
"""


@query(f"""WITH f AS (SELECT *, type || '|' || lower(value) AS k FROM ({select("events", FINDS)})), d AS (SELECT DISTINCT queue, k, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * CAST(substr(value, 2) AS INT) AS t FROM f WHERE type = 'error'),
    g AS (SELECT * FROM f WHERE (queue, k) NOT IN (SELECT queue, k FROM d WHERE t >= TIMESTAMP '2024-02-05' - INTERVAL 30 DAY) AND NOT (type = 'signup' AND queue = 0)),
    o AS (SELECT queue, k, count(*) AS n, min(ord) AS ord FROM g GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY ord DESC) AS r, count(*) OVER (PARTITION BY queue) AS c FROM o)
    SELECT queue, k, n, greatest(0, c - 30) AS dropped FROM r WHERE r <= 30""")
def t2_l7_e3_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = carrier(spark, sf_dir, "events", FINDS)
    day = F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(substring(value, 2) as int))")
    dismissed = found.filter("type = 'error'").select("queue", timeline.key().alias("k"), day.alias("t")).distinct()
    held = found.filter("type = 'signup' and queue = 0").select("queue", "type", "value").distinct()
    return timeline.triaged(found, dismissed, held, F.lit("2024-02-05").cast("timestamp"), 30).select("queue", "k", "n", "dropped")


ITEMS = """
p_size % 6 AS case_id
p_partkey AS ord
CASE p_partkey % 9 WHEN 0 THEN 'ipv4' WHEN 1 THEN 'domain' WHEN 2 THEN 'url' WHEN 3 THEN 'md5' WHEN 4 THEN 'cve' WHEN 5 THEN 'email' WHEN 6 THEN 'tgchan' WHEN 7 THEN 'attack' ELSE 'sha256' END AS type
CASE p_partkey % 9 WHEN 0 THEN concat('203.0.113.', p_partkey % 256) WHEN 1 THEN concat('d', p_partkey, '.example.com') WHEN 2 THEN concat('https://u.example.com/', p_partkey, '?q=''x') WHEN 3 THEN md5(concat('', p_partkey)) WHEN 4 THEN concat('CVE-2021-', 10000 + p_partkey) WHEN 5 THEN concat('m', p_partkey, '@example.org') WHEN 6 THEN concat('t.me/chan', p_partkey) WHEN 7 THEN concat('T', 1000 + p_partkey % 20, CASE WHEN p_partkey % 2 = 0 THEN '.001' ELSE '' END) ELSE concat(md5(concat('', p_partkey)), md5('x')) END AS value
CASE p_size % 5 WHEN 0 THEN 'malicious' WHEN 1 THEN 'suspicious' WHEN 2 THEN 'clean' WHEN 3 THEN 'irrelevant' END AS verdict
CASE WHEN p_partkey % 2 = 0 THEN 'lab "A"' ELSE '' END AS verdict_source
CASE WHEN p_partkey % 3 = 0 THEN 'seen' ELSE '' END AS note
"""
_ITEMS_SQL = select("part", ITEMS)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return carrier(spark, sf_dir, "part", ITEMS).withColumn("tags", none).withColumn("flags", F.when(F.col("ord") % 4 == 0, F.array(F.lit("ambiguous:refang"))).otherwise(none)).withColumn("own", F.col("ord") % 11 == 0)


@query(f"SELECT case_id, " + ", ".join(f"count_if(coalesce(verdict, 'unknown') = '{v}')::BIGINT AS {v}" for v in ("malicious", "suspicious", "clean", "irrelevant", "unknown")) + f" FROM ({_ITEMS_SQL}) GROUP BY case_id")
def a5_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.verdicts(_items(spark, sf_dir))


@query(f"""SELECT * FROM (SELECT ord, list_filter([CASE WHEN verdict IS NOT NULL AND verdict_source = '' THEN 'no source' END, CASE WHEN ord % 4 = 0 THEN 'guessed' END], lambda x: x IS NOT NULL) AS reasons FROM ({_ITEMS_SQL})) WHERE len(reasons) > 0""")
def p17_needs_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.undecided(_items(spark, sf_dir).withColumn("from_image", F.lit(False))).select("ord", "reasons")


@query(f"""SELECT ord, '"' || type || '","' || replace(value, '"', '""') || '","1","false","","' || coalesce(verdict, 'unknown') || '","' || replace(verdict_source, '"', '""') || '","' || note || '","","",""' AS line FROM ({_ITEMS_SQL}) WHERE ord % 4 <> 0""")
def k1_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).filter("ord % 4 <> 0").withColumn("n", F.lit(1)).withColumn("defanged", F.lit(False)).withColumn("source", F.lit("")).withColumn("context", F.lit(None).cast("string"))
    return rows.select("ord", exports.csv_line().alias("line"))


@query(f"""SELECT ord, CASE type WHEN 'ipv4' THEN '[ipv4-addr:value = ''' || value || ''']' WHEN 'domain' THEN '[domain-name:value = ''' || value || ''']' WHEN 'url' THEN '[url:value = ''' || replace(value, '''', '\\''') || ''']'
    WHEN 'md5' THEN '[file:hashes.''MD5'' = ''' || value || ''']' WHEN 'email' THEN '[email-addr:value = ''' || value || ''']' WHEN 'tgchan' THEN '[url:value = ''https://' || value || ''']' ELSE '[file:hashes.''SHA-256'' = ''' || value || ''']' END AS pattern,
    CASE verdict WHEN 'malicious' THEN 85 WHEN 'suspicious' THEN 50 ELSE 15 END AS confidence FROM ({_ITEMS_SQL}) WHERE type NOT IN ('cve', 'attack') AND coalesce(verdict, '') NOT IN ('clean', 'irrelevant')""")
def k2_k3_k4_stix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.stix(_items(spark, sf_dir), "2024-01-01T00:00:00.000Z").select("ord", "pattern", "confidence")


@query()
def k2_stix_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.bundle(exports.stix(_items(spark, sf_dir), "2024-01-01T00:00:00.000Z"))


_OK = f"""SELECT *, row_number() OVER (PARTITION BY case_id, type ORDER BY ord) AS r FROM ({_ITEMS_SQL}) WHERE coalesce(verdict, '') NOT IN ('clean', 'irrelevant') AND ord % 11 <> 0"""


@query(f"""SELECT case_id, type, count(*) AS n FROM ({_OK}) WHERE type IN ('domain', 'url', 'ipv4', 'md5') AND r <= 300 GROUP BY ALL""")
def p16_rule_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.eligible(_items(spark, sf_dir), ["domain", "url", "ipv4", "md5"]).groupBy("case_id", "type").agg(F.count("*").alias("n"))


@query(f"""SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY ord) + 999999 AS INTEGER) AS sid FROM ({_OK}) WHERE type IN ('domain', 'url', 'ipv4', 'ipv6') AND r <= 300""")
def k8_w8_suricata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.suricata(_items(spark, sf_dir)).select("case_id", "sid")


@query(f"""SELECT case_id, '$s' || row_number() OVER (PARTITION BY case_id ORDER BY ord) AS name, value FROM ({_OK}) WHERE type IN ('domain', 'url', 'email') AND r <= 300""")
def k9_yara_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.yara_strings(_items(spark, sf_dir))


@query()
def k9_yara(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.yara(_items(spark, sf_dir))


@query()
def k7_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.sigma(_items(spark, sf_dir))


@query(f"""SELECT case_id, type, string_agg('| ' || replace(value, '|', '\\|') || ' | ' || coalesce(verdict, 'unknown') || ' |', chr(10) ORDER BY ord) FILTER (r <= 20) || CASE WHEN count(*) > 20 THEN chr(10) || '… and ' || (count(*) - 20) || ' more' ELSE '' END AS "table"
    FROM (SELECT *, row_number() OVER (PARTITION BY case_id, type ORDER BY ord) AS r FROM ({_ITEMS_SQL})) GROUP BY case_id, type""")
def k12_a13_report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.report(_items(spark, sf_dir), 20)


TECHNIQUES = [(f"T{1000 + k}{s}", f"Technique {k}{s}", [["execution"], ["persistence", "execution"], ["discovery"]][k % 3]) for k in range(16) for s in ("", ".001")]
_TECHNIQUES_SQL = ", ".join(f"('{i}', '{n}', {t!r})" for i, n, t in TECHNIQUES)


def _techniques(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TECHNIQUES, "id string, name string, tactics array<string>")


_CASE = f"""c(id, name, tactics) AS (VALUES {_TECHNIQUES_SQL}), i AS ({_ITEMS_SQL}), k AS (SELECT case_id, value AS id, arg_min(coalesce(verdict, 'unknown'), ord) AS verdict FROM i WHERE type = 'attack' GROUP BY ALL)"""


@query(f"WITH {_CASE}, t AS (SELECT k.*, unnest(tactics) AS tactic FROM k JOIN c USING (id)) SELECT case_id, tactic, " + ", ".join(f"count_if(verdict = '{v}')::BIGINT AS {v}" for v in attack.VERDICTS) + " FROM t GROUP BY ALL")
def a7_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attack.coverage(_items(spark, sf_dir), _techniques(spark))


@query(f"WITH {_CASE} SELECT case_id, count_if(c.id IS NOT NULL)::BIGINT AS known, count_if(c.id IS NULL)::BIGINT AS unknown_ids FROM k LEFT JOIN c USING (id) GROUP BY case_id")
def a7_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attack.overall(_items(spark, sf_dir), _techniques(spark))


@query(f"""WITH {_CASE}, b AS (SELECT case_id, string_split(id, '.')[1] AS base, bool_or(id NOT LIKE '%.%') AS own FROM k GROUP BY ALL)
    SELECT case_id, unnest(tactics) AS tactic, base AS id, NOT own AS dimmed FROM b JOIN c ON c.id = base""")
def a8_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attack.matrix(_items(spark, sf_dir), _techniques(spark))


@query(f"WITH {_CASE} SELECT i.ord, i.value AS technique, c.name, CASE WHEN i.value LIKE '%.%' THEN string_split(i.value, '.')[1] END AS parent, c.id IS NOT NULL AS known FROM i LEFT JOIN c ON c.id = i.value WHERE i.type = 'attack'")
def j16_technique_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attack.looked_up(_items(spark, sf_dir).filter("type = 'attack'"), _techniques(spark)).select("ord", "technique", "name", "parent", "known")


@query(f"WITH {_CASE} SELECT case_id, CAST(count(*) AS INTEGER) AS n FROM k GROUP BY case_id")
def k6_layer_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attack.layer(_items(spark, sf_dir)).select("case_id", "n")


@query()
def k6_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attack.layer(_items(spark, sf_dir))


@query("SELECT * FROM (VALUES ('T1001', 'Technique 1', 1), ('T1001.001', 'Technique 1.001', 1), ('T1000', 'Technique 0', 1), ('T1000.001', 'Technique 0.001', 1), ('T1002', 'Technique 2', 1), ('T1002.001', 'Technique 2.001', 1), ('T1003', 'Technique 3', 1), ('T1003.001', 'Technique 3.001', 1)) AS t(id, name, rank)")
def l1_technique_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attack.searched(_techniques(spark), "t100")


PACK = [("certutil.exe", "Certutil.exe", ["download", "encode"]), ("bash", "bash", ["shell"]), ("bitsadmin.exe", "Bitsadmin.exe", ["download"]), ("tar", "tar", ["file-read"])]


def _pack(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PACK, "key string, name string, categories array<string>")


@query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Certutil.exe' WHEN 1 THEN 'bash' WHEN 2 THEN 'tar' END AS entry FROM customer")
def j17_pack_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = carrier(spark, sf_dir, "customer", "c_custkey AS id\nCASE c_custkey % 4 WHEN 0 THEN 'C:/Windows/CERTUTIL.exe' WHEN 1 THEN '/bin/bash' WHEN 2 THEN 'x/tar.exe' ELSE 'none.exe' END AS path")
    return attack.pack_lookup(c, _pack(spark)).select("id", "entry")


@query("SELECT * FROM (VALUES ('Bitsadmin.exe', 2), ('Certutil.exe', 2)) AS t(name, rank)")
def l2_pack_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attack.ranked_packs(_pack(spark), "downl")


@query("""SELECT * FROM (VALUES ('A.exe', ['download', 'execute'], ['T1000', 'T1001']), ('B.exe', ['execute'], ['T1002'])) AS t(name, categories, techniques)""")
def s17_pack_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.createDataFrame(
        [("A.exe", [("execute", "T1001"), ("download", "T1000"), ("execute", "T1001")]), ("B.exe", [("execute", "T1002")])], "Name string, Commands array<struct<Category: string, MitreID: string>>"
    )
    return attack.folded_binaries(raw)


NEW = """
c_nationkey AS case_id
c_custkey AS ord
'domain' AS type
concat('D', c_custkey % 90, '.example.com') AS value
"""


@query(f"""WITH n AS ({select("customer", NEW)}), c AS (SELECT DISTINCT case_id, type, lower(value) AS value FROM n WHERE ord % 3 = 0)
    SELECT case_id, value, false AS new FROM c UNION ALL SELECT case_id, arg_min(value, ord), true FROM n WHERE (case_id, lower(value)) NOT IN (SELECT case_id, value FROM c) GROUP BY case_id, lower(value)""")
def e2_add_to_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = carrier(spark, sf_dir, "customer", NEW)
    case = new.filter("ord % 3 = 0").select("case_id", "type", F.lower("value").alias("value")).distinct()
    return timeline.added(case, new).select("case_id", "value", "new")


@query(f"""WITH n AS ({select("customer", NEW)}), c AS (SELECT DISTINCT case_id, lower(value) AS value FROM n WHERE ord % 3 = 0)
    SELECT n.case_id, count_if(c.value IS NOT NULL)::BIGINT AS known, count_if(c.value IS NULL)::BIGINT AS new FROM n LEFT JOIN c ON c.case_id = n.case_id AND c.value = lower(n.value) GROUP BY n.case_id""")
def j15_p21_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = carrier(spark, sf_dir, "customer", NEW)
    return timeline.novelty(new, new.filter("ord % 3 = 0"))

"""Queries over indicators in text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exact, extract
from .registry import carrier, query, select, table

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NATIVE = f"""SELECT doc_id, 'ipv4' AS type, unnest(regexp_extract_all(text, '\\b(?:{_OCTET}\\.){{3}}{_OCTET}\\b')) AS value FROM documents
    UNION ALL SELECT doc_id, 'email', unnest(regexp_extract_all(text, '\\b[A-Za-z0-9._%+\\-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?\\.)+[A-Za-z]{{2,24}}\\b')) FROM documents
    UNION ALL SELECT doc_id, 'sha1', unnest(regexp_extract_all(text, '\\b[A-Fa-f0-9]{{40}}\\b')) FROM documents
    UNION ALL SELECT doc_id, 'sha256', unnest(regexp_extract_all(text, '\\b[A-Fa-f0-9]{{64}}\\b')) FROM documents
    UNION ALL SELECT doc_id, 'md5', unnest(regexp_extract_all(text, '\\b[A-Fa-f0-9]{{32}}\\b')) FROM documents"""
NATIVE = ["ipv4", "email", "sha1", "sha256", "md5"]


@query(f"SELECT doc_id, type, lower(value) AS value, count(*) AS n FROM ({_NATIVE}) GROUP BY ALL")
def x1_x3_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.indicators(table(spark, sf_dir, "documents"), types=NATIVE).select("doc_id", "type", F.lower("value").alias("value"), "n")


@query(f"SELECT type, lower(value) AS value, count(DISTINCT doc_id) AS documents, count(*) AS n FROM ({_NATIVE}) GROUP BY ALL")
def a9_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.prevalence(table(spark, sf_dir, "documents"), NATIVE)


REPORT = """
c_custkey AS doc_id
concat('Report ', c_custkey, '. See hxxps://h', c_custkey, '[.]example[.]com/p?a=1, and 203[.]0[.]113[.]', c_custkey % 256, '. Mail u', c_custkey, '@example.org. ', CASE c_custkey % 5 WHEN 0 THEN concat('CVE-2021-', 10000 + c_custkey) WHEN 1 THEN concat('MITRE ATT&CK T', 1000 + c_custkey % 9000, '.001 used') WHEN 2 THEN 'file setup.zip from evil.example.net' WHEN 3 THEN concat('net 198.51.100.0/', c_custkey % 33) ELSE 'key HKLM\\\\Software\\\\Run, x' END, chr(10), md5(concat('', c_custkey)), ' seen twice ', md5(concat('', c_custkey))) AS text
"""
# DuckDB reads backslashes in strings as they are.
_REPORT_SQL = """WITH r AS (SELECT c_custkey AS k FROM customer)
    SELECT k AS doc_id, 'url' AS type, 'https://h' || k || '.example.com/p?a=1' AS value, 1::BIGINT AS n FROM r
    UNION ALL SELECT k, 'ipv4', '203.0.113.' || (k % 256), 1 FROM r UNION ALL SELECT k, 'email', 'u' || k || '@example.org', 1 FROM r
    UNION ALL SELECT k, 'cve', 'CVE-2021-' || (10000 + k), 1 FROM r WHERE k % 5 = 0 UNION ALL SELECT k, 'attack', 'T' || (1000 + k % 9000) || '.001', 1 FROM r WHERE k % 5 = 1
    UNION ALL SELECT k, 'domain', 'evil.example.net', 1 FROM r WHERE k % 5 = 2 UNION ALL SELECT k, 'cidr', '198.51.100.0/' || (k % 33), 1 FROM r WHERE k % 5 = 3
    UNION ALL SELECT k, 'regkey', 'HKLM\\Software\\Run', 1 FROM r WHERE k % 5 = 4 UNION ALL SELECT k, 'md5', md5('' || k), 2 FROM r"""


@query(_REPORT_SQL)
def x1_x2_report_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.indicators(carrier(spark, sf_dir, "customer", REPORT)).select("doc_id", "type", "value", "n")


@query(_REPORT_SQL)
def x1_report_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.extracted(carrier(spark, sf_dir, "customer", REPORT)).select("doc_id", "type", "value", "n")


@query(f"SELECT doc_id, type, lower(value) AS value, count(*) AS n FROM ({_NATIVE}) GROUP BY ALL")
def x1_exact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.extracted(table(spark, sf_dir, "documents"), loose=False)
    return found.filter(F.col("type").isin(NATIVE)).select("doc_id", "type", F.lower("value").alias("value"), "n")


TAILED = """
c_custkey AS doc_id
concat('at host', c_custkey, '.example.com:8443 and 203.0.113.', c_custkey % 200, ':70000 then path', c_custkey, '.example.org/a/b.txt, end') AS text
"""


@query("""WITH r AS (SELECT c_custkey AS k FROM customer)
    SELECT k AS doc_id, 'domain' AS type, 'host' || k || '.example.com' AS value, ['port:8443'] AS flags FROM r UNION ALL SELECT k, 'ipv4', '203.0.113.' || (k % 200), [] FROM r
    UNION ALL SELECT k, 'url', 'path' || k || '.example.org/a/b.txt', ['ambiguous:no-scheme'] FROM r""")
def x10_x11_ports_and_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.extracted(carrier(spark, sf_dir, "customer", TAILED)).select("doc_id", "type", "value", "flags")


WRAPPED = """
c_custkey AS doc_id
CASE WHEN c_custkey % 2 = 0 THEN concat('hash', chr(10), substring(sha1(concat('', c_custkey)), 1, 25), chr(10), substring(sha1(concat('', c_custkey)), 26, 15)) ELSE concat(md5(concat('a', c_custkey)), chr(10), md5(concat('b', c_custkey))) END AS text
"""


@query("""WITH r AS (SELECT c_custkey AS k FROM customer)
    SELECT k AS doc_id, 'sha1' AS type, sha1('' || k) AS value, ['ambiguous:wrap'] AS flags FROM r WHERE k % 2 = 0
    UNION ALL SELECT k, 'md5', unnest([md5('a' || k), md5('b' || k)]), ['ambiguous:md5-or-ja3'] FROM r WHERE k % 2 = 1""")
def n7_n8_wrapped_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.extracted(carrier(spark, sf_dir, "customer", WRAPPED)).select("doc_id", "type", "value", "flags")


RECORDS = """
c_custkey AS doc_id
concat(c_custkey, ',url,http://r', c_custkey, '.example.com/x,done,', c_nationkey) AS text
"""


@query("SELECT c_custkey AS doc_id, 'url' AS type, 'http://r' || c_custkey || '.example.com/x' AS value FROM customer")
def x9_record_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.indicators(carrier(spark, sf_dir, "customer", RECORDS), types=["url"]).select("doc_id", "type", "value")


@query(f"""SELECT doc_id, type, value, trim(regexp_replace(substr(text, greatest(1, p - 60), 60 + length(value) + least(60, p - 1)), '\\s+', ' ', 'g')) AS context
    FROM (SELECT *, instr(text, value) AS p FROM (SELECT doc_id, type, min(value) AS value FROM ({_NATIVE}) WHERE type = 'ipv4' GROUP BY doc_id, type, lower(value)) JOIN documents USING (doc_id))""")
def x15_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return extract.with_context(docs, extract.indicators(docs, types=["ipv4"])).select("doc_id", "type", "value", "context")

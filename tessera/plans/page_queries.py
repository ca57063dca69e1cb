"""Queries over pages by their tree, answers of servers, captures, the workplace's settings and what is opened at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attack, keeping, noise, settings
from ..sources import pages
from .case_queries import _CASE, _items, _techniques
from .registry import carrier, query

PAGES = """
c_custkey AS page_id
CASE c_custkey % 5 WHEN 0 THEN concat('<html><head><title> T ', c_custkey, '</title></head><body><nav>menu</nav><article><h1>Head ', c_custkey, '</h1><p>see <a href="https://e', c_custkey, '.example/x">this</a> <a href="#top">up</a></p></article><footer>f</footer></body></html>') WHEN 1 THEN concat('<body><div class="site-menu">m m</div><main>Main ', c_custkey, '<div>110</div><div id="share">s</div><div>a@b.example</div></main></body>') WHEN 2 THEN concat('<body><div class="header-wrap">Long enough text ', c_custkey, '</div><p>x</p></body>') WHEN 3 THEN concat('<html><body><div id="root"></div><script>', repeat('v', 600), '</script></body></html>') ELSE concat('<body><script type="application/json">["', repeat('w', 80), c_custkey, '"]</script></body>') END AS html
"""


@query("""SELECT c_custkey AS page_id, CASE c_custkey % 5 WHEN 0 THEN 'T ' || c_custkey ELSE '' END AS title,
    CASE c_custkey % 5 WHEN 0 THEN 'T ' || c_custkey || chr(10) || 'Head ' || c_custkey || chr(10) || 'see this up' || chr(10) || chr(10) || 'https://e' || c_custkey || '.example/x'
        WHEN 1 THEN chr(10) || 'Main ' || c_custkey || '110' || chr(10) || 'a@b.example' || chr(10) WHEN 2 THEN chr(10) || 'Long enough text ' || c_custkey || chr(10) || 'x' || chr(10)
        WHEN 3 THEN chr(10) || chr(10) ELSE chr(10) || repeat('w', 80) || c_custkey END AS text,
    CASE c_custkey % 5 WHEN 2 THEN ['furniture kept'] WHEN 3 THEN ['a script''s shell'] WHEN 4 THEN ['from embedded data'] ELSE [] END AS notes FROM customer""")
def s10_page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.texts(carrier(spark, sf_dir, "customer", PAGES))


@query("""SELECT c_custkey AS page_id, 'seen ' || c_custkey || chr(10) || 'link' || chr(10) || 'js' || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'more' ELSE '' END || chr(10) || '/l' || c_custkey AS text FROM customer""")
def s14_shown_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = """c_custkey AS page_id
        concat('<title>t</title><body><p>seen ', c_custkey, '</p> <p style="display: none">no</p><div style="visibility:hidden"><b>no</b></div><textarea>no</textarea><a href="/l', c_custkey, '">link</a><script>no</script><a href="javascript:x">js</a><div ', CASE WHEN c_custkey % 2 = 0 THEN 'class=x' ELSE 'hidden' END, '>more</div>') AS html"""
    return pages.shown(carrier(spark, sf_dir, "customer", html))


@query("""SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 2 THEN 'a PDF' WHEN 3 THEN 'status 404' WHEN 5 THEN 'not a page: image/png' END AS refused, CASE c_custkey % 7 WHEN 0 THEN 'windows-1251' WHEN 1 THEN 'windows-1251' WHEN 4 THEN 'utf-8' WHEN 6 THEN 'utf-8' END AS charset,
    CASE c_custkey % 7 WHEN 0 THEN false WHEN 1 THEN true WHEN 4 THEN true WHEN 6 THEN false END AS is_html,
    CASE c_custkey % 7 WHEN 0 THEN 'Привет ' || c_custkey WHEN 1 THEN '<html><meta charset="windows-1251">Привет' WHEN 4 THEN ' <!DOCTYPE html>é' || c_custkey WHEN 6 THEN 'é' END AS text FROM customer""")
def s13_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, hello = F.col("id") % 7, "CFF0E8E2E5F2"
    utf = lambda c: F.encode(c, "UTF-8")
    page = F.concat(utf(F.lit('<html><meta charset="windows-1251">')), F.unhex(F.lit(hello)))
    content = F.when(k == 0, F.concat(F.unhex(F.lit(hello + "20")), utf(F.col("id").cast("string")))).when(k == 1, page)
    content = content.when(k == 4, utf(F.concat(F.lit(" <!DOCTYPE html>é"), F.col("id").cast("string")))).otherwise(utf(F.lit("é")))
    kind = F.when(k == 0, "text/plain; charset=Windows-1251").when(k == 1, "text/html").when(k == 2, "application/pdf").when(k == 5, "Image/PNG; x=1").when(k == 6, "text/plain; charset=no-such")
    rows = carrier(spark, sf_dir, "customer", "c_custkey AS id")
    return pages.answers(rows.select("id", F.when(k == 3, 404).otherwise(200).alias("status"), kind.alias("content_type"), content.alias("content")))


@query("""SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN 300000 ELSE 3 END AS n FROM nation WHERE n_nationkey % 3 < 2""")
def s15_captured_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = carrier(spark, sf_dir, "nation", "n_nationkey AS id\nCASE n_nationkey % 3 WHEN 0 THEN repeat('ab ', 100001) WHEN 1 THEN ' x ' ELSE '   ' END AS text")
    return pages.captured(rows).select("id", F.length("text").alias("n"))


URLS = """
c_custkey AS id
CASE c_custkey % 6 WHEN 0 THEN concat('hxxps://www[.]google-analytics[.]com/c?x=', c_custkey) WHEN 1 THEN 'Google-Analytics dot com/collect' WHEN 2 THEN concat('https://google-analytics.com.evil', c_custkey, '.example/') WHEN 3 THEN 'http[:]//u@google-analytics.com.:80/' WHEN 4 THEN '  ' ELSE concat('https://e', c_custkey, '.example/google-analytics.com') END AS url
"""


@query("SELECT c_custkey AS id, c_custkey % 6 IN (0, 1, 3) AS telemetry FROM customer")
def p8_telemetry_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.telemetry_urls(carrier(spark, sf_dir, "customer", URLS)).select("id", "telemetry")


@query(f"""WITH {_CASE}, b AS (SELECT DISTINCT case_id, string_split(id, '.')[1] AS id FROM k), s AS (SELECT b.case_id, b.id, coalesce(k.verdict, 'unknown') AS verdict FROM b JOIN c ON c.id = b.id AND len(c.tactics) > 0 LEFT JOIN k ON k.case_id = b.case_id AND k.id = b.id
    UNION ALL SELECT k.case_id, k.id, k.verdict FROM k JOIN c ON c.id = k.id JOIN c AS p ON p.id = string_split(k.id, '.')[1] AND len(p.tactics) > 0 WHERE k.id LIKE '%.%')
    SELECT case_id, {", ".join(f"count_if(verdict = '{v}')::BIGINT AS {v}" for v in attack.VERDICTS)} FROM s GROUP BY case_id""")
def k16_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attack.legend(_items(spark, sf_dir), _techniques(spark))


@query("SELECT o_orderkey AS id, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 5)::INTEGER AS batch, 400 * batch AS wait FROM orders")
def l12_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keeping.batched(carrier(spark, sf_dir, "orders", "o_orderkey AS id\no_custkey AS who"), ["who"], "id").select("id", "batch", "wait")


FEATURE = settings.Feature
PLAN = settings.Plan(
    (FEATURE("parse", core=True, tab="indicators"), FEATURE("matrix", tab="matrix"), FEATURE("picture", needs="matrix"), FEATURE("mail", needs="parse", tab="mail"), FEATURE("archive", needs="mail", tab="archive")),
    {"basic": ("matrix", "mail"), "all": ("matrix", "picture", "mail", "archive"), "bare": ()},
    "basic",
)
_BITS = {"matrix": 1, "picture": 2, "mail": 4, "archive": 8}
_ON = {i: f"(c_custkey // {b}) % 2 = 1" for i, b in _BITS.items()}


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.create_map(*[c for i, b in _BITS.items() for c in (F.lit(i), F.expr(f"(c_custkey div {b}) % 2 = 1"))])
    return carrier(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("id"), bits.alias("flags"))


@query(f"""WITH o AS (SELECT c_custkey AS id, {", ".join(f"{x} AS {i}" for i, x in _ON.items())} FROM customer)
    SELECT id, CASE WHEN matrix AND mail AND NOT picture AND NOT archive THEN 'basic' WHEN matrix AND picture AND mail AND archive THEN 'all' WHEN NOT (matrix OR picture OR mail OR archive) THEN 'bare' ELSE 'свой' END AS preset,
        list_filter(['indicators', CASE WHEN matrix THEN 'matrix' END, CASE WHEN mail THEN 'mail' END, CASE WHEN mail AND archive THEN 'archive' END], lambda x: x IS NOT NULL) AS tabs,
        list_filter([CASE WHEN NOT matrix THEN 'matrix' END, CASE WHEN NOT (matrix AND picture) THEN 'picture' END, CASE WHEN NOT mail THEN 'mail' END, CASE WHEN NOT (mail AND archive) THEN 'archive' END], lambda x: x IS NOT NULL) AS off,
        CASE id % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'bare' ELSE CASE WHEN matrix AND mail AND NOT picture AND NOT archive THEN 'basic' WHEN matrix AND picture AND mail AND archive THEN 'all' WHEN NOT (matrix OR picture OR mail OR archive) THEN 'bare' ELSE 'свой' END END AS chosen,
        CASE WHEN matrix AND mail AND NOT archive THEN CASE WHEN picture THEN 'свой' ELSE 'basic' END WHEN matrix AND picture AND mail AND archive THEN 'all' WHEN NOT (matrix OR picture OR mail OR archive) THEN 'bare' ELSE 'свой' END AS core_toggled,
        CASE WHEN matrix AND NOT mail AND NOT picture AND NOT archive THEN 'basic' WHEN matrix AND picture AND archive AND NOT mail THEN 'all' WHEN mail AND NOT (matrix OR picture OR archive) THEN 'bare' ELSE 'свой' END AS mail_toggled FROM o""")
def e7_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags, preset = F.col("flags"), F.when(F.col("id") % 3 == 0, "all").when(F.col("id") % 3 == 1, "bare").otherwise("no such")
    match = lambda m: settings.matching(PLAN, m)
    return _flags(spark, sf_dir).select(
        "id", match(flags).alias("preset"), settings.visible(PLAN, flags).alias("tabs"), settings.switched_off(PLAN, flags).alias("off"), match(settings.applied(PLAN, flags, preset)).alias("chosen"),
        match(settings.toggled(PLAN, flags, F.lit("parse"), F.lit(False))).alias("core_toggled"), match(settings.toggled(PLAN, flags, F.lit("mail"), ~flags["mail"])).alias("mail_toggled"),
    )


FILES = """
c_custkey AS id
CASE c_custkey % 7 WHEN 0 THEN 'no json' WHEN 1 THEN '{"вид":"other"}' WHEN 2 THEN '{"вид":"settings","версия":1,"пресет":"bare","функции":{}}' WHEN 3 THEN concat('{"вид":"settings","версия":3,"пресет":"odd","функции":{"matrix":true,"picture":"yes","mail":1,"archive":true,"parse":false,"x', c_custkey, '":true}}') WHEN 4 THEN '{"вид":"settings","пресет":"all","функции":{"picture":false,"archive":false}}' WHEN 5 THEN '{"вид":"settings"}' ELSE '{"вид":"settings","пресет":"свой","функции":{"matrix":null}}' END AS raw
"""


@query("""SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'no settings' WHEN 1 THEN 'another file: other' END AS error, CASE c_custkey % 7 WHEN 2 THEN 'bare' WHEN 3 THEN 'all' WHEN 4 THEN 'basic' WHEN 5 THEN 'basic' WHEN 6 THEN 'свой' END AS preset,
    CASE c_custkey % 7 WHEN 2 THEN ['parse'] WHEN 3 THEN ['archive', 'mail', 'matrix', 'parse', 'picture'] WHEN 4 THEN ['mail', 'matrix', 'parse'] WHEN 5 THEN ['mail', 'matrix', 'parse'] WHEN 6 THEN ['mail', 'parse'] END AS on,
    CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 3 THEN ['a newer version: unknown fields are dropped', 'parse: a core feature stays on', 'picture: neither true nor false', 'mail: neither true nor false', 'unknown features dropped: x' || c_custkey, 'unknown preset: odd']
        WHEN 6 THEN ['matrix: neither true nor false'] ELSE [] END AS notes FROM customer""".replace("AS on,", 'AS "on",'))
def k17_settings_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = carrier(spark, sf_dir, "customer", FILES).select("id", settings.from_file(PLAN, "settings", F.col("raw")).alias("r"))
    return r.select("id", "r.error", "r.preset", F.array_sort(F.map_keys(F.map_filter("r.flags", lambda k, v: v))).alias("on"), "r.notes")


@query("""SELECT c_custkey AS id, true AS same FROM customer""")
def k17_settings_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flags(spark, sf_dir)
    raw = settings.to_file(PLAN, "settings", F.col("flags"), settings.matching(PLAN, F.col("flags")))
    back = rows.select("id", "flags", settings.matching(PLAN, F.col("flags")).alias("preset"), settings.from_file(PLAN, "settings", raw).alias("r"))
    same = F.col("r.error").isNull() & (F.size("r.notes") == 0) & (F.col("preset") == F.col("r.preset"))
    for i in _BITS:
        same = same & (F.col("flags")[i] == F.col("r.flags")[i])
    return back.select("id", same.alias("same"))

"""Stores as functions from old to new tables: imports with counts of what was dropped, packs, caps, gates, settings, and texts for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

CASES, TAGS, FILTERS, ADDRESSES, DENIED, ROWS = 50, 12, 50, 30, 200, 60
CASE_SCHEMA = "STRUCT<items: ARRAY<STRUCT<type: STRING, value: STRING, verdict: STRING>>, cases: ARRAY<STRUCT<items: ARRAY<STRUCT<type: STRING, value: STRING, verdict: STRING>>>>>"


def imported(raw: DataFrame) -> DataFrame:
    """id, ord, type, value, verdict of exported cases ({items} or {cases: [{items}]}); rows without a value are left out."""
    parsed = raw.select("id", F.from_json("raw", CASE_SCHEMA).alias("c"))
    items = F.coalesce(F.col("c.items"), F.flatten(F.transform("c.cases", lambda x: F.coalesce(x["items"], F.array().cast("array<struct<type: string, value: string, verdict: string>>")))))
    rows = parsed.select("id", F.posexplode(items).alias("ord", "i"))
    return rows.filter(F.coalesce("i.value", F.lit("")) != "").select("id", "ord", F.coalesce("i.type", F.lit("keyword")).alias("type"), "i.value", F.coalesce("i.verdict", F.lit("unknown")).alias("verdict"))


def import_problems(raw: DataFrame) -> DataFrame:
    """id, problem, n: unreadable files, items without a value."""
    parsed = raw.select("id", F.from_json("raw", CASE_SCHEMA).alias("c"))
    items = F.coalesce(F.col("c.items"), F.flatten(F.col("c.cases.items")))
    bad = parsed.filter(items.isNull()).select("id", F.lit("no items").alias("problem"), F.lit(1).cast("long").alias("n"))
    empty = parsed.select("id", F.size(F.filter(items, lambda i: F.coalesce(i["value"], F.lit("")) == "")).cast("long").alias("n")).filter("n > 0")
    return bad.unionByName(empty.select("id", F.lit("no value").alias("problem"), "n"))


def folded_functions(raw: DataFrame) -> DataFrame:
    """name, categories of a pack whose executables carry functions; a file without the section is an error."""
    parsed = raw.select(F.from_json("raw", "executables MAP<STRING, STRUCT<functions: MAP<STRING, STRING>>>")["executables"].alias("e"))
    sure = F.when(F.col("e").isNotNull(), F.col("e")).otherwise(F.raise_error(F.lit("no section `executables`")))
    return parsed.select(F.explode(sure).alias("name", "v")).select("name", F.array_sort(F.map_keys(F.coalesce("v.functions", F.create_map().cast("map<string, string>")))).alias("categories"))


def plausible_pack(pack: DataFrame, least: int = 50) -> DataFrame:
    """names, sound: a pack with fewer distinct names than `least` is refused."""
    return pack.agg(F.count_distinct("name").alias("names")).withColumn("sound", F.col("names") >= least)


def newest(rows: DataFrame, by: list[str], order: str, cap: int) -> DataFrame:
    """The newest rows of each key up to a cap."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).filter(F.col("_r") <= cap).drop("_r")


def gate(stored: DataFrame) -> DataFrame:
    """mode by policy: a locked policy, then what is stored, then the policy's default, then public."""
    known = lambda c: F.when(F.col(c).isin("public", "client"), F.col(c))
    return stored.withColumn("mode", F.coalesce(F.when(F.col("locked"), known("policy")), known("stored"), known("policy"), F.lit("public")))


def fetch_address(c: Column) -> Column:
    """struct(url, refused): armed again, https by default; refused are other schemes, missing and internal hosts."""
    from .ranges import internal_reason

    v = F.trim(T.refang(c))
    url = F.when(v.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), v).otherwise(F.concat(F.lit("https://"), v))
    host = T.url_host(url)
    refused = F.when(~T.url_scheme(url).isin("http", "https"), "scheme").when((host == "") | ~F.contains(host, F.lit(".")) & (host != "localhost"), "host").when(internal_reason(host).isNotNull(), "internal")
    return F.struct(url.alias("url"), refused.alias("refused"))


def useful_link(c: Column) -> Column:
    return ~F.trim(c).rlike(r"(?i)^(?:javascript:|data:|mailto:|tel:|#|/?$)")


def highlightable(found: DataFrame) -> DataFrame:
    return found.filter(~F.col("type").isin("attack", "asn") & ~F.exists("flags", lambda f: f.startswith("non-routable:")))


def census(lines: DataFrame) -> DataFrame:
    """doc_id, length, n: lines of hexadecimal digits alone, by length."""
    bare = F.trim(F.col("line"))
    return lines.filter(bare.rlike(r"\A[0-9a-fA-F]{8,}\z")).groupBy("doc_id", F.length(bare).alias("length")).agg(F.count("*").alias("n"))


def line_above(lines: DataFrame) -> DataFrame:
    """Adds the last line before that isn't blank."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    full = F.when(F.trim(F.regexp_replace("line", P.java("~s+"), " ")) != "", F.col("line"))
    return lines.withColumn("above", F.last(full, ignorenulls=True).over(w))


def record_pairs(lines: DataFrame) -> DataFrame:
    """Adds record: whether a line and the next have the same delimiter twice, so that no value runs on between them."""
    first = lambda c: F.coalesce(*[F.when(F.length(c) - F.length(F.replace(c, F.lit(d), F.lit(""))) >= 2, F.lit(d)) for d in (",", ";", "\t", "|")])
    after = F.lead("line").over(Window.partitionBy("doc_id").orderBy("pos"))
    return lines.withColumn("record", F.coalesce(first(F.col("line")) == first(after), F.lit(False)))


def unused(usage: DataFrame, as_of: Column, core: list[str], days: int = 30) -> DataFrame:
    """feature, idle_days of features that nobody opened for so long; core features are never named."""
    idle = F.date_diff(as_of, F.col("last").cast("date"))
    return usage.withColumn("idle_days", idle).filter(~F.col("feature").isin(core) & (F.col("idle_days") >= days)).select("feature", "idle_days")


def tactic_techniques(catalogue: DataFrame, tactic: str, limit: int = 8) -> DataFrame:
    return catalogue.filter(F.exists("tactics", lambda t: F.contains(F.lower(t), F.lit(tactic.lower())))).orderBy("id").limit(limit).select("id", "name")


def matching(catalogue: DataFrame, platform: str | None = None, tactic: str | None = None) -> DataFrame:
    out = catalogue if platform is None else catalogue.filter(F.array_contains("platforms", platform))
    return out if tactic is None else out.filter(F.array_contains("tactics", tactic))


def capped_rows(edges: DataFrame, cap: int = ROWS) -> DataFrame:
    """A case's relation rows by source, then those without; beyond the cap one row says how many more."""
    w = Window.partitionBy("case_id").orderBy(F.col("to").isNull(), "to", "from")
    ranked = edges.withColumn("_r", F.row_number().over(w))
    kept = ranked.filter(F.col("_r") <= cap).select("case_id", "from", "to", F.lit(None).cast("long").alias("more"))
    rest = ranked.filter(F.col("_r") > cap).groupBy("case_id").agg(F.count("*").alias("more"))
    return kept.unionByName(rest.select("case_id", F.lit(None).cast("string").alias("from"), F.lit(None).cast("string").alias("to"), "more"))


def case_json(items: DataFrame, events: DataFrame) -> DataFrame:
    """case_id, json: the export of a case with items in order and its log."""
    i = items.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("ord", "type", "value", "verdict"))).alias("items"))
    e = events.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("t", "kind"))).alias("timeline"))
    full = i.join(e, "case_id", "left")
    return full.select("case_id", F.to_json(F.struct(F.transform("items", lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"), x["verdict"].alias("verdict"))).alias("items"), "timeline")).alias("json"))


def handover(items: DataFrame, listed: int = 20, open_listed: int = 30) -> DataFrame:
    """case_id, text: counts by verdict, then the malicious, suspicious and unchecked ones, each list cut with how many more there are."""
    v = F.coalesce("verdict", F.lit("unknown"))
    own = items.withColumn("v", v).withColumn("r", F.row_number().over(Window.partitionBy("case_id", v).orderBy("ord"))).withColumn("n", F.count("*").over(Window.partitionBy("case_id", v)))
    cap = F.when(F.col("v") == "unknown", open_listed).when(F.col("v").isin("malicious", "suspicious"), listed).otherwise(0)
    lines = own.groupBy("case_id", "v", "n").agg(F.array_sort(F.collect_list(F.when(F.col("r") <= cap, F.struct("r", F.concat(F.lit("  - "), "value").alias("t"))))).alias("l"))
    rank = F.array_position(F.array(*map(F.lit, ("malicious", "suspicious", "clean", "irrelevant", "unknown"))), F.col("v"))
    more = F.when(F.col("n") > cap, F.concat(F.lit("\n  - … and "), (F.col("n") - cap).cast("string"), F.lit(" more"))).otherwise("")
    part = F.concat("v", F.lit(": "), F.col("n").cast("string"), F.when(cap > 0, F.concat(F.lit("\n"), F.array_join(F.transform("l", lambda x: x["t"]), "\n"), more)).otherwise(""))
    return lines.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("k"), part.alias("p")))), lambda x: x["p"]), "\n").alias("text"))


def log_markdown(events: DataFrame, limit: int = 200) -> DataFrame:
    """case_id, text: the first events by day."""
    w = Window.partitionBy("case_id").orderBy("t", "ord")
    own = events.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= limit)
    line = F.concat(F.lit("- `"), F.date_format("t", "HH:mm"), F.lit("` "), "kind")
    days = own.groupBy("case_id", F.date_format("t", "dd.MM.yyyy").alias("day")).agg(F.min("r").alias("r"), F.array_sort(F.collect_list(F.struct("r", line.alias("l")))).alias("l"))
    text = F.concat(F.lit("**"), "day", F.lit("**\n\n"), F.array_join(F.transform("l", lambda x: x["l"]), "\n"))
    return days.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", text.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def search_address(engine: str, query: Column, span: str = "") -> Column:
    """A search page's address for a query, with a span of day, week, month or year where the engine knows one."""
    extra = f"&time_range={span}" if span in ("day", "week", "month", "year") else ""
    return F.concat(F.lit(f"{engine.rstrip('/')}/search?q="), T.percent_encode(query), F.lit(extra))

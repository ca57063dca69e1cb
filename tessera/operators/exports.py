"""Exports: CSV lines, STIX bundles, detection-rule drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CSV_HEAD = "type,value,count,defanged,flags,verdict,verdict_source,note,tags,source,context"
# Which pattern names a type's value, and how sure a verdict is.
STIX = {
    "ipv4": "ipv4-addr:value", "ipv6": "ipv6-addr:value", "cidr": "ipv4-addr:value", "domain": "domain-name:value", "url": "url:value", "email": "email-addr:value", "md5": "file:hashes.'MD5'",
    "sha1": "file:hashes.'SHA-1'", "sha256": "file:hashes.'SHA-256'", "sha512": "file:hashes.'SHA-512'", "onion": "domain-name:value", "btc": "cryptocurrency-wallet:value",
    "eth": "cryptocurrency-wallet:value", "tgchan": "url:value", "dsinvite": "url:value",
}
CONFIDENCE = {"malicious": 85, "suspicious": 50, "unknown": 15}
EXCLUDED = ("clean", "irrelevant")
SID, SID_LAST, PER_TYPE = 1_000_000, 1_999_999, 300


def csv_line() -> Column:
    """A line of the fixed columns, every field quoted."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    cols = [F.col("type"), F.col("value"), F.col("n"), F.col("defanged"), F.array_join("flags", ";"), F.coalesce("verdict", F.lit("unknown")), F.col("verdict_source"), F.col("note"), F.array_join("tags", ";"), F.col("source"), F.col("context")]
    return F.concat_ws(",", *map(cell, cols))


def full_address(v: Column) -> Column:
    """Channel and invite links get a scheme on export."""
    return F.when(v.rlike("(?i)^https?://"), v).otherwise(F.concat(F.lit("https://"), v))


def stix_pattern() -> Column:
    """The pattern of an item; null for types without one."""
    quoted = F.when(F.col("type").isin("url", "tgchan", "dsinvite"), F.replace("value", F.lit("'"), F.lit("\\'"))).otherwise(F.col("value"))
    value = F.when(F.col("type").isin("tgchan", "dsinvite"), full_address(quoted)).otherwise(quoted)
    path = F.create_map(*[F.lit(x) for kv in STIX.items() for x in kv])
    return F.concat(F.lit("["), F.try_element_at(path, F.col("type")), F.lit(" = '"), value, F.lit("']"))


def stix(items: DataFrame, now: str) -> DataFrame:
    """case_id, ord, object: an indicator object for each item that has a pattern and isn't cleared. Ids are derived from the content, so reruns agree."""
    verdict = F.coalesce("verdict", F.lit("unknown"))
    own = items.withColumn("pattern", stix_pattern()).filter(F.col("pattern").isNotNull() & ~verdict.isin(*EXCLUDED))
    h = F.md5(F.concat_ws("|", F.col("case_id").cast("string"), "type", "value"))
    uid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    sure = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    description = F.nullif(F.concat_ws("\n", F.nullif("note", F.lit("")), F.when(F.col("verdict_source") != "", F.concat(F.lit("Checked: "), F.col("verdict_source")))), F.lit(""))
    labels = F.concat(F.array(F.concat(F.lit("verdict:"), verdict)), F.coalesce("tags", F.array().cast("array<string>")))
    return own.select(
        "case_id", "ord", "pattern", F.try_element_at(sure, verdict).alias("confidence"),
        F.to_json(F.struct(F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), F.concat(F.lit("indicator--"), uid).alias("id"), F.lit(now).alias("created"), F.lit(now).alias("modified"), F.col("value").alias("name"), "pattern",
            F.lit("stix").alias("pattern_type"), F.lit(now).alias("valid_from"), labels.alias("labels"), F.try_element_at(sure, verdict).alias("confidence"), description.alias("description"))).alias("object"),
    )


def excluded(items: DataFrame) -> DataFrame:
    return items.filter(F.col("verdict").isin(*EXCLUDED)).select("case_id", "value")


def bundle(objects: DataFrame) -> DataFrame:
    """case_id, bundle: a case's objects in order, in one JSON text; a case holds thousands of items at most."""
    rows = objects.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "object"))), lambda x: x["object"]).alias("o"))
    return rows.select("case_id", F.concat(F.lit('{"type":"bundle","objects":['), F.array_join("o", ","), F.lit("]}")).alias("bundle"))


def eligible(items: DataFrame, types: list[str], per_type: int = PER_TYPE) -> DataFrame:
    """Items that rules may name: not cleared, not own or non-routable, of a type that rules know, the first ones of each type."""
    own = items.filter(F.col("type").isin(types) & ~F.coalesce("verdict", F.lit("unknown")).isin(*EXCLUDED) & ~F.coalesce("own", F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("case_id", "type").orderBy("ord"))
    return own.withColumn("_r", rank).filter(F.col("_r") <= per_type).drop("_r")


def suricata(items: DataFrame) -> DataFrame:
    """case_id, sid, rule: a draft for each domain, address with a path, and IP address; numbers run within the case."""
    ok = eligible(items, ["domain", "url", "ipv4", "ipv6"])
    sid = F.row_number().over(Window.partitionBy("case_id").orderBy("ord")) + (SID - 1)
    v = F.replace("value", F.lit('"'), F.lit("|22|"))
    content = (
        F.when(F.col("type") == "domain", F.concat(F.lit('alert dns any any -> any any (msg:"case domain"; dns.query; content:"'), v, F.lit('"; nocase; sid:')))
        .when(F.col("type") == "url", F.concat(F.lit('alert http any any -> any any (msg:"case url"; http.host; content:"'), F.lower(F.regexp_extract(v, "://([^/?#]*)", 1)), F.lit('"; sid:')))
        .otherwise(F.concat(F.lit("alert ip any any -> ["), v, F.lit('] any (msg:"case address"; sid:')))
    )
    return ok.withColumn("sid", sid).filter(F.col("sid") <= SID_LAST).select("case_id", "sid", F.concat(content, F.col("sid").cast("string"), F.lit("; rev:1;)")).alias("rule"))


def yara_strings(items: DataFrame) -> DataFrame:
    """case_id, name, value: the numbered strings of a case's string rule."""
    ok = eligible(items, ["domain", "url", "email"])
    n = F.row_number().over(Window.partitionBy("case_id").orderBy("ord"))
    return ok.select("case_id", F.concat(F.lit("$s"), n.cast("string")).alias("name"), F.replace(F.replace("value", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')).alias("value"))


def yara(items: DataFrame) -> DataFrame:
    """case_id, rule: a string rule and a hash rule."""
    s = yara_strings(items).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(F.substring("name", 3, 9).cast("int").alias("k"), F.concat(F.lit("    "), "name", F.lit(' = "'), "value", F.lit('" ascii wide nocase')).alias("t")))).alias("s"))
    line = F.concat(F.lit("    hash."), F.col("type"), F.lit('(0, filesize) == "'), F.lower("value"), F.lit('"'))
    h = eligible(items, ["md5", "sha1", "sha256"]).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("t")))).alias("h"))
    lines = lambda c, sep: F.array_join(F.transform(c, lambda x: x["t"]), sep)
    rule = F.concat_ws(
        "\n\n", F.when(F.col("h").isNotNull(), F.lit('import "hash"')),
        F.when(F.col("s").isNotNull(), F.concat(F.lit("rule case_strings {\n  strings:\n"), lines(F.col("s"), "\n"), F.lit("\n  condition:\n    any of them\n}"))),
        F.when(F.col("h").isNotNull(), F.concat(F.lit("rule case_hashes {\n  condition:\n"), lines(F.col("h"), " or\n"), F.lit("\n}"))),
    )
    return s.join(h, "case_id", "full_outer").select("case_id", rule.alias("rule"))


# Where each type stands in logs (log source, field).
SIGMA = {"domain": ("dns", "query"), "url": ("proxy", "c-uri"), "ipv4": ("firewall", "dst_ip"), "ipv6": ("firewall", "dst_ip"), "md5": ("process_creation", "Hashes"), "sha1": ("process_creation", "Hashes"), "sha256": ("process_creation", "Hashes")}


def sigma(items: DataFrame) -> DataFrame:
    """case_id, logsource, rule: a YAML draft for each log source, with a selection for each type."""
    ok = eligible(items, list(SIGMA))
    source = F.create_map(*[F.lit(x) for k, v in SIGMA.items() for x in (k, v[0])])
    field = F.create_map(*[F.lit(x) for k, v in SIGMA.items() for x in (k, v[1])])
    quoted = F.concat(F.lit("            - '"), F.replace("value", F.lit("'"), F.lit("''")), F.lit("'"))
    one = ok.groupBy("case_id", source[F.col("type")].alias("logsource"), "type").agg(F.array_sort(F.collect_list(F.struct("ord", quoted.alias("t")))).alias("v"), F.min("ord").alias("ord"))
    n = F.row_number().over(Window.partitionBy("case_id", "logsource").orderBy("ord"))
    block = F.concat(F.lit("    selection_"), n.cast("string"), F.lit(":\n        "), field[F.col("type")], F.lit("|contains:\n"), F.array_join(F.transform("v", lambda x: x["t"]), "\n"))
    rows = one.withColumn("n", n).withColumn("block", block)
    rule = rows.groupBy("case_id", "logsource").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n").alias("b"))
    return rule.select("case_id", "logsource", F.concat(F.lit("title: case "), F.col("logsource"), F.lit("\nlogsource:\n    category: "), F.col("logsource"), F.lit("\ndetection:\n"), F.col("b"), F.lit("\n    condition: 1 of selection_*")).alias("rule"))


def report(items: DataFrame, cap: int = 60) -> DataFrame:
    """case_id, type, table: a Markdown table of each type's items, with how many more there are beyond the cap."""
    rank = F.row_number().over(Window.partitionBy("case_id", "type").orderBy("ord"))
    total = F.count("*").over(Window.partitionBy("case_id", "type"))
    rows = items.withColumn("_r", rank).withColumn("_n", total).filter(F.col("_r") <= cap)
    cell = F.concat(F.lit("| "), F.replace("value", F.lit("|"), F.lit("\\|")), F.lit(" | "), F.coalesce("verdict", F.lit("unknown")), F.lit(" |"))
    one = rows.groupBy("case_id", "type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", cell.alias("c")))), lambda x: x["c"]), "\n").alias("t"), F.first("_n").alias("n"))
    more = F.when(F.col("n") > cap, F.concat(F.lit("\n… and "), (F.col("n") - cap).cast("string"), F.lit(" more"))).otherwise("")
    return one.select("case_id", "type", F.concat("t", more).alias("table"))


RULE_TYPES = ("domain", "email", "ipv4", "ipv6", "md5", "sha1", "sha256", "url")


def assembled(items: DataFrame, per_type: int = PER_TYPE) -> DataFrame:
    """case_id, sigma, suricata, yara (null: nothing to put there), notes: a case's drafts and, in words, what is not in them."""
    own, known = F.coalesce("own", F.lit(False)), F.col("type").isin(*RULE_TYPES)
    open_ = items.filter(~F.coalesce("verdict", F.lit("unknown")).isin(*EXCLUDED))
    by = open_.groupBy("case_id", "type").agg(F.count_if(~own).alias("n"), F.count_if(own & known).alias("own"))
    unused = F.when(~known & (F.col("n") > 0), F.concat("type", F.lit(": "), F.col("n").cast("string"), F.lit(" values, no rule is made of this type")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    per = by.groupBy("case_id").agg(total("own").alias("own"), total(F.when(known, F.greatest(F.col("n") - per_type, F.lit(0)))).alias("over"), F.array_sort(F.collect_list(unused)).alias("types"))
    joined = lambda rows, key, sep: rows.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "rule"))), lambda x: x["rule"]), sep).alias("rule"))
    drafts = {"sigma": joined(sigma(items), "logsource", "\n---\n"), "suricata": joined(suricata(items), "sid", "\n"), "yara": yara(items)}
    out = items.select("case_id").distinct().join(per, "case_id", "left")
    for name, rows in drafts.items():
        out = out.join(rows.select("case_id", F.col("rule").alias(name)), "case_id", "left")
    none = F.coalesce(*drafts).isNull()
    note = lambda c, words: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(words)))
    notes = F.concat(
        F.array(note("own", " own values are left out"), note("over", f" values are left out: at most {per_type} of a type")), "types",
        F.array(*[F.when(F.col(c).isNull(), F.lit(f"{c}: nothing to put in a rule")) for c in drafts]),
    )
    notes = F.when(none, F.array(F.lit("no indicator of the case can be in a rule; cleared and irrelevant ones are left out on purpose"))).otherwise(F.filter(notes, lambda x: x.isNotNull()))
    return out.select("case_id", *drafts, notes.alias("notes"))

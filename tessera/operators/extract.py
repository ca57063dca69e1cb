"""Indicators in text, as native expressions: one linear pass for each type whose signs a text holds, each type's finds masked for the next.

This tier states the priority of types, tail trimming, record cuts, context gates, domain filters, dedup and counts in built-in functions. What needs
positions inside a text (port and path tails, guess passes, wrapped values) is in exact.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

NUL = "\x00"


def _record_cut(value: Column, line: Column) -> Column:
    """The value up to a delimiter that stands at least twice in its line outside it."""
    out = value
    many = lambda x, d: F.length(x) - F.length(F.replace(x, F.lit(d), F.lit("")))
    hit = None
    for d in (",", ";", "\t", "|"):
        record = (many(line, d) - many(value, d)) >= 2
        cut = F.when(F.instr(value, d) > 1, F.substring_index(value, d, 1)).otherwise(value)
        hit = F.when(record, cut) if hit is None else hit.when(record, cut)
    return hit.otherwise(out)


def _hits(type_: str, mask: Column) -> Column:
    found = F.regexp_extract_all(mask, F.lit(P.java(P.TYPES[type_])), F.lit(0))
    if type_ in ("url", "regkey", "winpath"):
        line_hits = lambda l: F.transform(F.regexp_extract_all(l, F.lit(P.java(P.TYPES[type_])), F.lit(0)), lambda v: _record_cut(T.trim_tail(v), l))  # noqa: E731, E741
        return F.filter(F.flatten(F.transform(F.split(mask, "\n"), line_hits)), lambda v: v != "")
    if type_ == "attack":
        # Among the lines that aren't blank, the last one before a line is its neighbour.
        lines = F.filter(F.split(mask, "\n"), lambda l: F.trim(l) != "")  # noqa: E741
        before = lambda i: F.coalesce(F.get(lines, i - 1), F.lit(""))
        gate = lambda l, i: F.when((F.regexp_count(l, F.lit(P.java(P.TYPES["attack"]))) > 0) & F.concat(before(i), F.lit("\n"), l).rlike(P.java(P.TECHNIQUE_CONTEXT)), l)  # noqa: E731, E741
        kept = F.array_compact(F.transform(lines, gate))
        return F.transform(F.flatten(F.transform(kept, lambda l: F.regexp_extract_all(l, F.lit(P.java(P.TYPES["attack"])), F.lit(0)))), T.canonical_technique)  # noqa: E741
    if type_ == "bdu":
        return F.transform(found, T.canonical_bdu)
    return found


def _typed(t: str):
    return lambda v, i: F.struct(F.lit(t).alias("type"), F.lit(P.ORDER.index(t)).alias("ord"), v.alias("value"), i.alias("pos"))


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text", types: list[str] | None = None) -> DataFrame:
    """key, type, ord (priority), value, pos: a row for each occurrence, in the order of the types and of the text."""
    own = docs.select(F.col(key).alias("_key"), F.col(text).alias("_raw"), T.refang(F.coalesce(F.col(text), F.lit(""))).alias("_m"))
    own = own.withColumn("_marked", F.when(F.col("_raw").rlike(r"[\[({<]\s{0,4}(?:\.|(?i:dot)|точка)"), T.defanged_values("_raw")).otherwise(F.array().cast("array<string>")))
    own = own.withColumn("_low", F.lower("_m")).withColumn("_hex", F.col("_m").rlike("[A-Fa-f0-9]{32}"))
    names = [t for t in P.ORDER if types is None or t in types]
    empty = F.array().cast("array<string>")
    for t in names:
        signs = P.SIGNS.get(t)
        gate = F.lit(True) if not signs else F.lit(False)
        for s in signs or []:
            gate = gate | F.contains("_low", F.lit(s))
        if t in ("sha512", "sha256", "sha1", "md5"):
            gate = F.col("_hex")
        if t == "ipv4" or t == "cidr":
            gate = F.col("_m").rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")
        if t == "domain":  # the pattern would try each label of a long run without a zone's ending
            gate = F.col("_m").rlike(r"\.(?:xn--[A-Za-z0-9-]{2,59}|[A-Za-z]{2,24})(?![A-Za-z0-9_])")
        own = own.withColumn(f"_{t}", F.when(gate, _hits(t, F.col("_m"))).otherwise(empty))
        own = own.withColumn("_m", F.when(F.size(f"_{t}") > 0, F.regexp_replace("_m", F.lit(P.java(P.TYPES[t])), F.lit(NUL))).otherwise(F.col("_m")))
    if "domain" in names:
        marked = F.col("_marked")
        own = own.withColumn("_domain", F.filter("_domain", lambda v: ~T.file_name(v, marked) & T.zone(v).isNotNull()))
    typed = [F.transform(f"_{t}", _typed(t)) for t in names]
    return own.select(F.col("_key").alias(key), F.inline(F.concat(*typed)))


def indicators(docs: DataFrame, key: str = "doc_id", text: str = "text", types: list[str] | None = None) -> DataFrame:
    """key, type, ord, value (first spelling), n, flags, scope, zone: the distinct indicators of each text.

    Counts are summed before the shuffle, so a text with one value a million times sends a row.
    """
    one = occurrences(docs, key, text, types).groupBy(key, "type", "ord", F.lower("value").alias("lower")).agg(F.count("*").alias("n"), F.min_by("value", "pos").alias("value"))
    scope = F.when(F.col("type") == "ipv4", T.ipv4_class("value"))
    flags = F.array_compact(
        F.concat(
            F.array(F.when((F.col("type") == "ipv4") & (T.ipv4_class("value") != "global"), F.concat(F.lit("non-routable:"), T.ipv4_class("value"))), F.when(F.col("type") == "md5", "ambiguous:md5-or-ja3")),
            F.when(F.col("type") == "domain", T.idn_flags("value")).otherwise(F.array().cast("array<string>")),
        )
    )
    return one.select(key, "type", "ord", "value", "n", flags.alias("flags"), scope.alias("scope"), F.when(F.col("type") == "domain", T.zone("value")).alias("zone"))


def prevalence(docs: DataFrame, types: list[str] | None = None) -> DataFrame:
    """type, value, documents, n: how many texts of the corpus hold an indicator, and how often."""
    one = indicators(docs, types=types)
    return one.groupBy("type", F.lower("value").alias("value")).agg(F.count("*").alias("documents"), F.sum("n").alias("n"))


def with_context(docs: DataFrame, found: DataFrame, around: int = 60, key: str = "doc_id") -> DataFrame:
    """Adds the text around an indicator's first place, blanks collapsed. Only texts that hold indicators travel."""
    at = F.instr(F.col("_text"), F.col("value"))
    cut = F.substring(F.col("_text"), F.greatest(F.lit(1), at - around), F.lit(around) + F.length("value") + F.least(F.lit(around), at - 1))
    text = docs.select(key, T.refang("text").alias("_text"))
    return found.join(text, key).withColumn("context", F.when(at > 0, F.trim(T.squeezed(cut)))).drop("_text")

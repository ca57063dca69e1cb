"""What in a report is furniture: links of platforms and services, telemetry, repeated lines, reference sections, contact lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

TIMES, SPREAD, KINDS, LINE, LEAST_LINES, TAIL = 3, 0.6, 12, 200, 6, 0.75


def host_lists(spark) -> DataFrame:
    """base, reason, rank: some 150 hosts, a bounded dimension."""
    rows = [(h, r, k) for k, (r, hosts) in enumerate((("platform", P.PLATFORMS), ("aggregator", P.AGGREGATORS), ("telemetry", P.TELEMETRY)), 1) for h in hosts]
    return F.broadcast(spark.createDataFrame(rows, "base string, reason string, rank int"))


def suffixes(host: Column) -> Column:
    """The host and each of its parents."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def classified(found: DataFrame, source_host: Column | None = None) -> DataFrame:
    """Adds noise and noise_reason to rows of (type, value): its own site, then platform, aggregator, telemetry.

    A host meets the list by equality with one of its suffixes, so the join is a hash join and not a test of each pair.
    """
    host = F.when(F.col("type").isin("url", "domain", "email"), T.host_of("type", "value")).otherwise("")
    own = found.withColumn("_host", host)
    # The reason is a function of the host alone, so the join is on hosts and needs no row numbers.
    hosts = own.select("_host").distinct().select("_host", F.explode(suffixes(F.col("_host"))).alias("base")).join(host_lists(found.sparkSession), "base")
    best = hosts.groupBy("_host").agg(F.min_by("reason", "rank").alias("_reason"))
    site = F.lit(False) if source_host is None else T.under("_host", source_host)
    out = own.join(best, "_host", "left").withColumn("noise_reason", F.when(site & (F.col("_host") != ""), "source").otherwise(F.col("_reason")))
    return out.withColumn("noise", F.col("noise_reason").isNotNull()).drop("_host", "_reason")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line, of (how many lines its text has)."""
    # The array is a column of its own first; beside a generator its size would be taken from a new split for each line.
    cut = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("_cut"))
    rows = cut.select("doc_id", F.size("_cut").alias("of"), F.posexplode("_cut").alias("pos", "line"))
    return rows.withColumn("line", F.when(F.col("line").endswith("\r") & (F.col("pos") < F.col("of") - 1), F.regexp_replace("line", "\r\\z", "")).otherwise(F.col("line")))


def normal(line: str = "line") -> Column:
    return F.lower(F.trim(T.squeezed(line)))


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line, part: furniture, contact, refs, or null for the report itself.

    Lines that repeat are found in sums by document and line; a document with few lines has no parts.
    """
    own = lines(docs).filter(F.col("of") >= LEAST_LINES).withColumn("key", normal())
    spread = (F.max("pos") - F.min("pos")) / F.greatest(F.lit(1), F.first("of") - 1)
    again = own.filter("key <> ''").filter(F.length("key") <= LINE).groupBy("doc_id", "key").agg(F.count("*").alias("n"), spread.alias("spread")).filter((F.col("n") >= TIMES) & (F.col("spread") >= SPREAD))
    few = again.groupBy("doc_id").agg(F.collect_set("key").alias("keys")).filter(F.size("keys") <= KINDS)
    from_ = F.floor(F.col("of") * TAIL)
    longest = max(map(len, P.REFERENCE_HEADINGS)) + 8
    heading = (F.col("pos") >= from_) & (F.length("key") <= longest) & F.regexp_replace("key", "[:：]\\s*$", "").isin(P.REFERENCE_HEADINGS)
    refs = own.filter(heading).groupBy("doc_id").agg(F.min("pos").alias("refs"))
    before = F.coalesce(F.lag("line").over(Window.partitionBy("doc_id").orderBy("pos")), F.lit(""))
    mail = (F.col("pos") >= from_) & F.contains(F.col("line"), F.lit("@")) & F.col("line").rlike(P.java(r"[^~s@]+@[^~s@]+\.[A-Za-z]{2,}"))  # cheap tests first
    contact = mail & F.concat(before, F.lit(" "), F.col("line")).rlike(P.java(P.CONTACT_PHRASES))
    marked = own.withColumn("contact", contact).join(few, "doc_id", "left").join(refs, "doc_id", "left")
    part = F.when(F.array_contains("keys", F.col("key")), "furniture").when(F.col("contact"), "contact").when(F.col("pos") >= F.col("refs"), "refs")
    return marked.select("doc_id", "pos", "line", part.alias("part"))


def document_noise(docs: DataFrame, found: DataFrame, extract) -> DataFrame:
    """doc_id, type, value, reason of indicators that stand only in furniture, contact lines or references.

    `found` has the counts over whole texts; `extract` is applied to the marked lines of each kind.
    """
    marked = parts(docs).filter("part is not null")
    texts = marked.groupBy("doc_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    keyed = texts.select(F.concat_ws("\x1f", F.col("doc_id").cast("string"), "part").alias("doc_id"), "text")
    inside = extract(keyed).select(F.split("doc_id", "\x1f").alias("_k"), "type", F.lower("value").alias("key"), F.col("n").alias("m"))
    inside = inside.select(F.col("_k")[0].cast("long").alias("doc_id"), F.col("_k")[1].alias("part"), "type", "key", "m")
    rank = F.when(F.col("part") == "furniture", 1).when(F.col("part") == "contact", 2).otherwise(3)
    best = inside.groupBy("doc_id", "type", "key").agg(F.sum("m").alias("m"), F.min_by("part", rank).alias("reason"))
    whole = found.select("doc_id", "type", F.lower("value").alias("key"), "value", "n")
    return whole.join(best, ["doc_id", "type", "key"]).filter("n <= m").select("doc_id", "type", "value", "reason")


def shell_like(html: str, text: str) -> Column:
    """Whether a page is a script's shell: under 900 characters of text and over 25 times as much markup."""
    return (F.length(text) < 900) & (F.length(html) > 25 * F.length(text))


# Fixed value: a dot in words, as it is undone in addresses before their host is read.
DOT_WORD = r"(?i)\s*\[?(?:точка|dot)\]?\s*"


def telemetry_urls(rows: DataFrame) -> DataFrame:
    """Adds telemetry to rows of (url): whether an address, disarmed or without a scheme, leads to a counter, a tracker or a widget."""
    armed = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce("url", F.lit(""))), "(?i)^h(?:xx|__)p", "http"), r"\[\.\]|\(\.\)|\{\.\}", ".")
    armed = F.regexp_replace(F.regexp_replace(armed, r"\[:\]", ":"), DOT_WORD, ".")
    full = F.when(armed.rlike("(?i)^[a-z][a-z0-9+.-]*://"), armed).otherwise(F.concat(F.lit("http://"), armed))
    own = rows.withColumn("_host", F.regexp_replace(T.url_host(full), r"\.$", ""))
    base = host_lists(rows.sparkSession).filter("reason = 'telemetry'").select("base")
    hit = own.select("_host").distinct().select("_host", F.explode(suffixes(F.col("_host"))).alias("base")).join(base, "base").select("_host").distinct()
    return own.join(hit.withColumn("telemetry", F.lit(True)), "_host", "left").withColumn("telemetry", F.coalesce("telemetry", F.lit(False))).drop("_host")


def token_like(part: Column) -> Column:
    """Whether a part of an address looks like a secret: sixteen characters or more, no slug, and hexadecimal, two digits or mixed case."""
    slug = part.rlike(r"\A[a-z]+(?:[-_][a-z]+)+\z")
    return part.rlike(r"\A[A-Za-z0-9_-]{16,}\z") & ~slug & (part.rlike(r"\A[0-9a-fA-F]+\z") | part.rlike("[0-9].*[0-9]") | (part.rlike("[a-z]") & part.rlike("[A-Z]")))

"""What a value says by itself, and addresses of searches for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

EMPTY = {"md5": "d41d8cd98f00b204e9800998ecf8427e", "sha1": "da39a3ee5e6b4b0d3255bfef95601890afd80709", "sha256": "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"}
SITES = 8


def _fact(name: str, value: Column, when: Column | bool = True) -> Column:
    return F.when(F.lit(when) if isinstance(when, bool) else when, F.struct(F.lit(name).alias("name"), value.cast("string").alias("value")))


def facts(type_: str = "type", value: str = "value", as_of_year: int = 2024) -> Column:
    """array<struct(name, value)> by type; unknown types and odd values have none."""
    t, v = F.col(type_), F.col(value)
    last = T.octet(v, 3)
    example = v.rlike(r"^(?:192\.0\.2|198\.51\.100|203\.0\.113)\.")
    ipv4 = [_fact("class", T.ipv4_class(v)), _fact("example", F.lit("RFC 5737"), example), _fact("form", F.lit("network"), last == 0), _fact("form", F.lit("broadcast"), last == 255)]
    low = F.lower(v)
    v6 = F.when(low == "::1", "loopback").when(low.startswith("fe80:"), "link-local").when(low.rlike("^f[cd]"), "unique-local").when(low.startswith("2001:db8"), "example").when(low.startswith("ff"), "multicast").otherwise("global")
    bits = F.substring_index(v, "/", -1).try_cast("int")
    size = F.pow(F.lit(2), 32 - bits).cast("long")
    labels = F.split(F.regexp_replace(v, r"\.$", ""), r"\.")
    length = F.length(v)
    year = F.regexp_extract(v, r"-(\d{4})-", 1).try_cast("int")
    params = F.regexp_count(F.regexp_extract(v, r"\?([^#]*)", 1), F.lit("[^&]+"))
    by_type = {
        "ipv4": ipv4, "ipv6": [_fact("class", v6), _fact("form", F.lit("short"), F.contains(v, F.lit("::")))],
        "cidr": [_fact("addresses", size), _fact("hosts", F.when(bits >= 31, size).otherwise(size - 2)), _fact("class", T.ipv4_class(F.substring_index(v, "/", 1)))],
        "domain": [_fact("zone", F.lower(F.element_at(labels, -1))), _fact("labels", F.size(labels)), _fact("idn", F.lit("puny"), F.lower(v).rlike(r"(?:^|\.)xn--")), _fact("idn", F.lit("letters"), ~v.rlike(r"\A[\x00-\x7F]*\z"))],
        "url": [_fact("host", T.url_host(v)), _fact("port", T.url_port(v), T.url_port(v) != ""), _fact("scheme", F.lit("plain"), T.url_scheme(v) == "http"), _fact("credentials", F.lit("yes"), v.rlike("^[a-z]+://[^/?#]*@")),
            _fact("file", F.regexp_extract(T.url_path(v), r"/([^/?]+\.[A-Za-z0-9]{1,5})(?:\?|$)", 1), T.url_path(v).rlike(r"/[^/?]+\.[A-Za-z0-9]{1,5}(?:\?|$)")), _fact("parameters", params, params > 0), _fact("host is", F.lit("address"), T.ipv4_number(T.url_host(v)).isNotNull())],
        "hash": [_fact("algorithm", F.when(length == 32, "MD5").when(length == 40, "SHA-1").when(length == 64, "SHA-256").when(length == 128, "SHA-512")), _fact("empty file", F.lit("yes"), F.lower(v).isin(*EMPTY.values()))],
        "cve": [_fact("year", year), _fact("age", F.lit(as_of_year) - year, year < as_of_year - 1)], "email": [_fact("domain", F.lower(F.substring_index(v, "@", -1)))],
        "tgchan": [_fact("link", F.when(v.rlike(r"(?i)/(?:joinchat/|\+)"), "invite").otherwise("channel"))], "btc": [_fact("format", F.when(v.startswith("bc1"), "bech32").when(v.startswith("3"), "script").otherwise("legacy"))],
        "winpath": [_fact("place", F.when(v.rlike(r"(?i)\\(?:temp|tmp)\\"), "temporary").when(v.rlike(r"(?i)\\appdata\\"), "profile").when(v.rlike(r"(?i)^[a-z]:\\windows\\"), "system"))],
    }
    name = F.when(t.isin("md5", "sha1", "sha256", "sha512"), "hash").otherwise(t)
    out = None
    for k, rows in by_type.items():
        some = F.filter(F.array(*rows), lambda f: f["value"].isNotNull())
        out = F.when(name == k, some) if out is None else out.when(name == k, some)
    return F.coalesce(out, F.array().cast("array<struct<name: string, value: string>>"))


def scoped_query(sites: DataFrame, terms: str, limit: int = SITES) -> DataFrame:
    """query_id, query, dropped: the terms with up to eight sites, hosts once (the first of each), those without a path first where not all fit."""
    bare = F.regexp_replace(F.regexp_replace(F.trim("site"), r"(?i)^[a-z]+://", ""), "/+$", "")
    own = sites.withColumn("_s", bare).withColumn("host", F.lower(F.regexp_extract("_s", "^([^/?#]+)", 1))).withColumn("path", F.contains("_s", F.lit("/")))
    one = own.groupBy("query_id", "host").agg(F.min_by(F.struct("_s", "path", "ord"), "ord").alias("f")).select("query_id", "f._s", "f.path", "f.ord")
    w = Window.partitionBy("query_id")
    ranked = one.withColumn("n", F.count("*").over(w))
    ranked = ranked.withColumn("r", F.row_number().over(w.orderBy(F.when(F.col("n") > limit, F.col("path").cast("int")).otherwise(0), "ord"))).filter(F.col("r") <= limit)
    parts = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("r", "_s"))).alias("p"), F.greatest(F.lit(0), F.first("n") - limit).alias("dropped"))
    scope = F.array_join(F.transform("p", lambda x: F.concat(F.lit("site:"), x["_s"])), " OR ")
    return parts.select("query_id", F.when(F.lit(terms).rlike(r"(?:^|\s|\()site:"), F.lit(terms)).otherwise(F.concat(F.lit(terms + " ("), scope, F.lit(")"))).alias("query"), "dropped")


def archive_links(url: Column) -> Column:
    """Addresses of a page's copies in public archives."""
    return F.array(F.concat(F.lit("https://web.archive.org/web/*/"), url), F.concat(F.lit("https://archive.ph/"), url), F.concat(F.lit("https://web.archive.org/save/"), url))


def highlighted(text: Column, value: str) -> Column:
    """The text with a value marked, however it is disarmed."""
    import re

    dot = r"\s{0,4}(?:\.|[\[({<]\s*(?:\.|dot)\s*[\])}>])\s{0,4}"
    pattern = dot.join(re.escape(p).replace("http", "h(?:tt|xx)p") for p in value.split("."))
    return F.regexp_replace(text, "(?i)" + pattern, "<mark>$0</mark>")


def tool_score(name: Column, note: Column, text: str) -> Column:
    """How well a service answers a search: its whole name, the name's start, a word's start, its inside, its note."""
    q, n = text.strip().lower(), F.lower(name)
    return F.when(n == q, 100).when(n.startswith(q), 80).when(F.contains(n, F.lit(" " + q)), 60).when(F.contains(n, F.lit(q)) | F.contains(F.lower(note), F.lit(q)), 40).otherwise(0)


def invocations(docs: DataFrame, pack: DataFrame) -> DataFrame:
    """doc_id, name, n: names of a pack of binaries that a text runs: with an ending, behind a path, before an option or a quote, behind a pipe or sudo."""
    word = r"(?i)(?:(sudo\s+|\|\s*)|([\\/]))?\b([a-z][a-z0-9_+.-]*?)(\.exe|\.dll|\.com|\.cmd|\.bat|\.vbs|\.ps1)?(?![a-z0-9_.])(\s+[-/][a-z]|\s*[\"'])?"
    rows = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(word), F.lit(0))).alias("m"))
    group = lambda k: F.regexp_extract("m", word, k)
    rows = rows.filter((group(1) != "") | (group(2) != "") | (group(4) != "") | (group(5) != ""))
    rows = rows.select("doc_id", F.lower(F.concat(group(3), group(4))).alias("key"), F.lower(group(3)).alias("bare"))
    keys = pack.select(F.lower("key").alias("key"), "name")
    hit = rows.join(keys, "key").select("doc_id", "name").unionByName(rows.filter("bare <> key").join(keys.withColumnRenamed("key", "bare"), "bare").select("doc_id", "name"))
    return hit.groupBy("doc_id", "name").agg(F.count("*").alias("n"))


# Templates of searches.
TEMPLATES = {
    "exact": '"{{q}}"',
    "filetype": "{{q}} filetype:pdf",
    "ioc-list": "{{q}} (filetype:csv OR filetype:txt OR filetype:json)",
    "title": 'intitle:"{{q}}"',
    "url": "inurl:{{q}}",
    "github": "site:github.com {{q}}",
    "paste": "(site:pastebin.com OR site:ghostbin.com OR site:rentry.co) {{q}}",
    "recent": "{{q}} (site:x.com OR site:infosec.exchange OR site:reddit.com)",
    "no-noise": "{{q}} -site:virustotal.com -site:abuseipdb.com -site:pulsedive.com",
}


def templated(queries: DataFrame) -> DataFrame:
    """The queries' columns, template, search: each template with the trimmed text in its place; blank texts have none."""
    own = queries.filter(F.trim("text") != "")
    rows = F.array(*[F.struct(F.lit(k).alias("template"), F.replace(F.lit(t), F.lit("{{q}}"), F.trim("text")).alias("search")) for k, t in TEMPLATES.items()])
    return own.select(*queries.columns, F.inline(rows))


def name_uuid(*parts: Column) -> Column:
    """A version-4 shaped UUID made from the parts' hash, so that a rerun names the same things alike."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def clock(c: Column) -> Column:
    """Hours and minutes of a time in text."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "HH:mm"), F.lit("--:--"))


def day(c: Column) -> Column:
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "dd.MM.yyyy"), F.lit("unknown date"))

"""HTTP archives in JSON, one per row, as entries, hosts, addresses and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MAX_BYTES, MAX_ENTRIES, HEADER, BODY = 50 * 1024 * 1024, 20_000, 300, 512 * 1024
_HEADERS = "headers ARRAY<STRUCT<name: STRING, value: STRING>>"
SCHEMA = f"""log STRUCT<version: STRING, pages: ARRAY<STRUCT<id: STRING>>, entries: ARRAY<STRUCT<startedDateTime: STRING, time: DOUBLE, serverIPAddress: STRING,
    request: STRUCT<method: STRING, url: STRING, {_HEADERS}>,
    response: STRUCT<status: INT, statusText: STRING, {_HEADERS}, redirectURL: STRING, bodySize: LONG, content: STRUCT<mimeType: STRING, size: LONG, text: STRING, encoding: STRING>>>>>"""
NOISY = r"^(?:image/|font/|text/css|application/font|audio/|video/)"
TEXTUAL = r"^text/|json|javascript|xml|^application/x-www-form"


def header(headers: Column, name: str) -> Column:
    """A header of the short list that is read at all; long values are cut."""
    v = F.try_element_at(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(-1))["value"]
    return F.when(F.length(v) > HEADER, F.concat(F.left(v, F.lit(HEADER)), F.lit("…"))).otherwise(v)


def status(raw: Column) -> Column:
    """`har`, `too large`, `incomplete` (a log without entries), or null: no archive."""
    log = F.get_json_object(raw, "$.log")
    return F.when(F.octet_length(raw) > MAX_BYTES, "too large").when(F.get_json_object(raw, "$.log.entries").startswith("["), "har").when(log.startswith("{"), "incomplete")


def resolved(target: Column, base: Column) -> Column:
    """A redirect's address made absolute."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target).when(target.startswith("//"), F.concat(T.url_scheme(base), F.lit(":"), target))
        .when(target.startswith("/"), F.concat(origin, target)).otherwise(F.concat(F.when(F.length(folder) > F.length(origin) + 1, folder).otherwise(F.concat(origin, F.lit("/"))), target))
    )


def entries(hars: DataFrame, bodies: bool = False) -> DataFrame:
    """har_id, n and the fields of each entry up to the limit; only listed headers are read, bodies only on request and only text."""
    parsed = hars.filter(status(F.col("raw")) == "har").select("har_id", F.from_json("raw", SCHEMA)["log"].alias("log"))
    e = parsed.select("har_id", F.posexplode("log.entries").alias("pos", "e")).filter(F.col("pos") < MAX_ENTRIES)
    req, res = F.col("e.request"), F.col("e.response")
    kind = F.lower(F.trim(F.substring_index(F.coalesce(res["content"]["mimeType"], header(res["headers"], "content-type"), F.lit("")), ";", 1)))
    url = F.coalesce(req["url"], F.lit(""))
    code = F.coalesce(res["status"], F.lit(0))
    target = F.trim(F.coalesce(F.nullif(res["redirectURL"], F.lit("")), header(res["headers"], "location"), F.lit("")))
    out = e.select(
        "har_id", (F.col("pos") + 1).alias("n"), F.upper(F.coalesce(req["method"], F.lit(""))).alias("method"), url.alias("url"), T.url_scheme(url).alias("scheme"), T.url_host(url).alias("host"), T.url_path(url).alias("path"),
        code.alias("status"), F.regexp_replace(F.coalesce(F.col("e.serverIPAddress"), F.lit("")), r"^\[|\]$", "").alias("ip"), kind.alias("mime"),
        F.coalesce(res["content"]["size"], res["bodySize"], F.lit(0)).alias("size"), F.round("e.time").cast("long").alias("ms"), F.coalesce("e.startedDateTime", F.lit("")).alias("start"),
        header(req["headers"], "referer").alias("referer"), header(req["headers"], "user-agent").alias("agent"), header(res["headers"], "location").alias("location"), header(res["headers"], "server").alias("server"),
        F.when(code.between(300, 399) & (target != ""), resolved(target, url)).otherwise("").alias("redirect"), kind.rlike(NOISY).alias("noisy"),
        *([_body(res["content"], kind).alias("body")] if bodies else []),
    )
    return out


def _body(content: Column, kind: Column) -> Column:
    text = F.when(F.lower(content["encoding"]) == "base64", F.decode(F.try_to_binary(F.regexp_replace(content["text"], r"\s+", ""), F.lit("base64")), "UTF-8")).otherwise(content["text"])
    return F.when(kind.rlike(TEXTUAL) & (F.length(content["text"]) <= BODY), text)


def hosts(e: DataFrame) -> DataFrame:
    """har_id, host, requests, ips, schemes, statuses (map), noisy (all of its entries are)."""
    some = e.filter("host <> ''")
    codes = some.groupBy("har_id", "host", "status").agg(F.count("*").alias("c")).groupBy("har_id", "host").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "c")))).alias("statuses"))
    full = some.groupBy("har_id", "host").agg(
        F.count("*").alias("requests"), F.array_sort(F.collect_set(F.nullif("ip", F.lit("")))).alias("ips"), F.array_sort(F.collect_set(F.nullif("scheme", F.lit("")))).alias("schemes"), F.bool_and("noisy").alias("noisy")
    )
    return full.join(codes, ["har_id", "host"])


def addresses(e: DataFrame) -> DataFrame:
    return e.filter("ip <> ''").groupBy("har_id", "ip").agg(F.count("*").alias("requests"), F.array_sort(F.collect_set(F.nullif("host", F.lit("")))).alias("hosts"))


def summary(e: DataFrame) -> DataFrame:
    start = F.nullif("start", F.lit(""))
    return e.groupBy("har_id").agg(
        F.count("*").alias("entries"), F.count_if("noisy").alias("noisy"), F.count_distinct(F.nullif("host", F.lit(""))).alias("hosts"), F.count_distinct(F.nullif("ip", F.lit(""))).alias("addresses"),
        F.min(start).alias("first"), F.max(start).alias("last"), F.count_if(F.col("ip") == "").alias("without_ip"),
    )


def text(e: DataFrame, noisy: bool = False) -> DataFrame:
    """har_id, text: what extraction is to read of an archive. An archive's lines are bounded by the entry limit."""
    line = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{name}: "), F.col(c)))
    lines = F.concat_ws("\n", F.concat(F.lit("URL: "), F.col("url")), line("Server-IP", "ip"), line("Referer", "referer"), line("Location", "location"), line("Server", "server"))
    rows = (e if noisy else e.filter("not noisy")).select("har_id", "n", lines.alias("t"))
    return rows.groupBy("har_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "\n").alias("text"))

"""Own networks: policy ranges and domains, classes of addresses, membership by range join."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def parsed_v4(policy: DataFrame, text: str = "cidr") -> DataFrame:
    """Adds base, bits, lo, hi, cidr (canonical), error: null base where the text is no range, a note where it isn't the network's start."""
    addr, mask = F.substring_index(F.trim(text), "/", 1), F.regexp_extract(F.trim(text), "/(.*)$", 1)
    number = T.ipv4_number(addr)
    bits = F.when(~F.contains(F.col(text), F.lit("/")), F.lit(32)).when(mask.rlike(r"\A\d{1,3}\z"), mask.cast("int"))
    good = number.isNotNull() & bits.isNotNull() & (bits <= 32)
    size = F.pow(F.lit(2.0), 32 - bits).cast("long")
    base = number - number % size
    error = (
        F.when(number.isNull(), "not an address").when(bits.isNull(), "mask is no number").when(bits > 32, "mask too long").when(base != number, "not the start of the network")
    )
    out = policy.withColumn("base", F.when(good, base)).withColumn("bits", F.when(good, bits)).withColumn("error", error)
    return out.withColumn("lo", F.col("base")).withColumn("hi", F.when(good, base + size - 1)).withColumn("canonical", F.when(good, F.concat_ws("/", T.ipv4_text("base"), F.col("bits"))))


def members_v4(values: DataFrame, policy: DataFrame, ip: str = "ip") -> DataFrame:
    """Adds ord and label of the first policy range that holds the address, in policy order; null outside all.

    The policy is a list of hundreds of ranges, held small by whoever writes it; it is expanded to the /8 blocks it touches and joined on them,
    so an address meets the ranges of its own block alone.
    """
    ranges = policy.filter("base is not null").withColumn("_block", F.explode(F.sequence(F.expr("lo div 16777216"), F.expr("hi div 16777216"))))
    own = values.withColumn("_n", T.ipv4_number(ip)).withColumn("_block", F.expr("_n div 16777216"))
    hit = own.select("_n", "_block").distinct().join(ranges.select("_block", "lo", "hi", "ord", "label", "canonical"), "_block").filter("_n between lo and hi")
    first = hit.groupBy("_n").agg(F.min_by(F.struct("ord", "label", "canonical"), "ord").alias("own"))
    return own.drop("_block").join(first, "_n", "left").drop("_n")


def owner(values: DataFrame, policy: DataFrame) -> DataFrame:
    """Adds own_kind (`policy`, `non-routable` or null) and own_mark for IPv4 values."""
    out = members_v4(values, policy)
    scope = T.ipv4_class("ip")
    kind = F.when(F.col("own").isNotNull(), "policy").when(scope != "global", "non-routable")
    mark = F.when(F.col("own").isNotNull(), F.when(F.col("own.label") != "", F.col("own.label")).otherwise(F.col("own.canonical"))).when(scope != "global", scope)
    return out.withColumn("own_kind", kind).withColumn("own_mark", mark).drop("own")


def owner_domain(values: DataFrame, domains: DataFrame) -> DataFrame:
    """Adds own_domain: the first policy domain, in policy order, that is the host or a parent of it."""
    from .noise import suffixes

    hosts = values.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("domain"))
    first = hosts.join(domains, "domain").groupBy("host").agg(F.min_by("domain", "ord").alias("own_domain"))
    return values.join(first, "host", "left")


def normal_domain(c: Column) -> Column:
    """Trimmed of dots, in lower case; empty where it isn't ASCII."""
    x = F.regexp_replace(F.lower(F.trim(c)), r"^\.+|\.+$", "")
    return F.when(x.rlike(r"\A[a-z0-9.-]+\z"), x).otherwise("")


def sendable(exposure: str, own: Column) -> Column:
    """Own values go to no public service."""
    return (F.col(exposure) != "public") | own.isNull()


def _v6(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def number(text: str | None) -> bytes | None:
        try:
            return ipaddress.IPv6Address((text or "").strip().strip("[]").split("%")[0].split("/")[0]).packed
        except ValueError:
            return None

    for s in frames:
        yield s.map(number)


def v6_bytes(c: Column) -> Column:
    """The sixteen bytes of an IPv6 address; they compare in the order of addresses."""
    return F.pandas_udf(_v6_udf, "binary")(c)


def _v6_udf(s: pd.Series) -> pd.Series:
    return next(_v6(iter([s])))


def v6_class(bytes_: Column) -> Column:
    h = F.hex(bytes_)
    first = F.conv(F.substring(h, 1, 4), 16, 10).cast("int")
    return (
        F.when(h == "0" * 31 + "1", "loopback").when(h == "0" * 32, "reserved").when(F.expr("true") & ((first >= 0xFC00) & (first < 0xFE00)), "unique-local")
        .when((first >= 0xFE80) & (first < 0xFEC0), "link-local").when(first >= 0xFF00, "multicast").when(h.isNotNull(), "global")
    )


def internal_reason(host: Column) -> Column:
    """Why a host is internal: a private name ending, a class of address, ::1; null for public hosts."""
    h = F.lower(host)
    scope = F.when(T.ipv4_number(h).isNotNull(), T.ipv4_class(h))
    return F.when(h.rlike(r"(?:^|\.)(?:internal|local|corp|lan|intranet|home\.arpa)$") | (h == "localhost"), "name").when(h.isin("::1", "[::1]"), "loopback").when(scope != "global", scope)

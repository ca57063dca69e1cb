"""Lists of values pasted as text: dedupe, difference, tags, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


def items(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each value of each list: key, ord, value (armed again)."""
    parts = F.filter(F.split(text, P.java(r"[~s,;]+")), lambda x: x != "")
    return df.select(key, F.posexplode(parts).alias("ord", "raw")).select(key, "ord", T.refang("raw").alias("value"))


def deduped(df: DataFrame, key: str, text: str) -> DataFrame:
    """Values of each list without regard to case, with the first spelling, how often it stands there, and its type."""
    one = items(df, key, text).groupBy(key, F.lower("value").alias("key")).agg(F.count("*").alias("n"), F.min_by("value", "ord").alias("value"))
    return one.withColumn("type", T.detect_type("value"))


def difference(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Keys that only the first, only the second, or both lists hold."""
    key = F.lower(T.refang(value)).alias("key")
    left, right = a.select(key).distinct().withColumn("_a", F.lit(True)), b.select(key).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("both")
    return left.join(right, "key", "full_outer").select("key", side.alias("side"))


def tags(text: str) -> Column:
    """Up to twelve distinct lower-case tags of a comma list."""
    return F.slice(F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")), 1, 12)


def expanded(template: Column, value: Column) -> Column:
    """A service's address for a value: {{ioc}} percent-encoded, {{ioc_raw}} as it is; without a value the service's start page."""
    filled = F.replace(F.replace(template, F.lit("{{ioc}}"), T.percent_encode(value)), F.lit("{{ioc_raw}}"), value)
    start = F.concat(F.regexp_extract(template, r"^([a-z]+://[^/?#]*)", 1), F.lit("/"))
    return F.when((value == "") & template.rlike(r"\{\{ioc(?:_raw)?\}\}"), start).otherwise(filled)

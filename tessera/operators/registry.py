"""Services for indicators: pivots, check sequences, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lists


def by_type(found: DataFrame, tools: DataFrame) -> DataFrame:
    """A row for each indicator and each service for its type; the registry has a few hundred services and AQE broadcasts it."""
    return found.join(tools.select(F.col("id").alias("tool"), "name", "url", "exposure", "pricing", F.explode("types").alias("type")), "type")


def closed_reason(mode: str, own: Column, hide_paid: bool) -> Column:
    """Why a service is closed for a value: mode, own, paid; null where it is open."""
    public = F.col("exposure") == "public"
    return F.when(F.lit(mode == "client") & public, "mode").when(public & own, "own").when(F.lit(hide_paid) & (F.col("pricing") == "paid"), "paid")


def pivot(found: DataFrame, tools: DataFrame, mode: str = "public", hide_paid: bool = False) -> DataFrame:
    """type, value, tool, reason, link. `found` has own (boolean)."""
    rows = by_type(found, tools).withColumn("reason", closed_reason(mode, F.coalesce("own", F.lit(False)), hide_paid))
    return rows.select("type", "value", "tool", "reason", F.when(F.col("reason").isNull(), lists.expanded(F.col("url"), F.col("value"))).alias("link"))


def closed_summary(pivoted: DataFrame) -> DataFrame:
    return pivoted.groupBy(F.coalesce("reason", F.lit("open")).alias("reason")).agg(F.count("*").alias("n"))


def plan(found: DataFrame, playbooks: DataFrame, tools: DataFrame, mode: str = "public") -> DataFrame:
    """A row for each step of each sequence that suits a value's type: value, playbook, step, tool, skipped (missing, type, mode, own)."""
    steps = playbooks.select(F.col("id").alias("playbook"), "types", F.posexplode("steps").alias("step", "tool"))
    suits = found.join(steps, F.array_contains(F.col("types"), F.col("type")))
    known = tools.select(F.col("id").alias("tool"), F.col("types").alias("_types"), "exposure")
    public = F.col("exposure") == "public"
    why = (
        F.when(F.col("_types").isNull(), "missing").when(~F.array_contains(F.col("_types"), F.col("type")), "type").when(F.lit(mode == "client") & public, "mode")
        .when(public & F.coalesce("own", F.lit(False)), "own")
    )
    return suits.join(known, "tool", "left").select("type", "value", "playbook", "step", "tool", why.alias("skipped"))


def applicable(playbooks: DataFrame, types: list[str]) -> DataFrame:
    return playbooks.filter(F.arrays_overlap("types", F.array(*map(F.lit, types))))


def problems(playbooks: DataFrame, tools: DataFrame) -> DataFrame:
    """playbook, problem, tool: repeated ids, steps that no service has, sequences of public services alone."""
    twice = playbooks.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("playbook"), F.lit("repeated id").alias("problem"), F.lit(None).cast("string").alias("tool"))
    steps = playbooks.select(F.col("id").alias("playbook"), F.explode("steps").alias("tool"))
    known = tools.select(F.col("id").alias("tool"), "exposure")
    gone = steps.join(known, "tool", "left_anti").select("playbook", F.lit("unknown tool").alias("problem"), "tool")
    public = steps.join(known, "tool").groupBy("playbook").agg(F.bool_and(F.col("exposure") == "public").alias("all")).filter("all")
    return twice.unionByName(gone).unionByName(public.select("playbook", F.lit("all public").alias("problem"), F.lit(None).cast("string").alias("tool")))


def derived_types(steps: DataFrame, tools: DataFrame) -> DataFrame:
    """list, type, ord: the types that a user's list of services covers, in order of their first service."""
    rows = steps.join(tools.select(F.col("id").alias("tool"), F.posexplode("types").alias("_k", "type")), "tool")
    return rows.groupBy("list", "type").agg(F.min(F.struct("ord", "_k")).alias("o")).select("list", "type", F.col("o.ord").alias("ord"))


def deny_listed(hosts: DataFrame, denied: DataFrame) -> DataFrame:
    """Rows whose host contains an entry of the deny list, of any length; letter case doesn't count, empty and null entries hold for none.

    A host holds few parts of the lengths that entries have, so entries meet parts by equality.
    """
    entries = denied.select(F.lower("entry").alias("part")).filter("part <> ''").distinct()
    lengths = sorted(r[0] for r in entries.select(F.length("part")).distinct().collect())  # a host has 253 letters at most
    low = F.lower("host")
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda k: F.substring(low, k, F.lit(n)))
    parts = [F.when(F.length(low) >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in lengths]
    every = F.explode(F.array_distinct(F.flatten(F.array(*parts)))) if parts else F.explode(F.array().cast("array<string>"))
    bad = hosts.select("host").distinct().select("host", every.alias("part")).join(entries, "part", "left_semi").select("host").distinct()
    return hosts.join(bad, "host", "left_semi").select(*hosts.columns)

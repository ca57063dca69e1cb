"""Stores that change: cases, per-case filters, the triage queue and the user's check list as functions from old tables to new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stores import CASES, FILTERS, newest

EPOCH = "1970-01-01T00:00:00.000Z"
# The check list's fields, id, name and version in files.
OWN_ID, OWN_NAME, VERSION = "мои-проверки", "Мои проверки", 2
TRIAGE = "items ARRAY<STRUCT<type: STRING, typeLabel: STRING, value: STRING, flags: ARRAY<STRING>, source: STRING, seenAt: STRING, count: DOUBLE>>, dismissed ARRAY<STRUCT<k: STRING, t: STRING>>, truncated DOUBLE"
CHECKS = "`версия` DOUBLE, `набор` STRUCT<name: STRING, steps: ARRAY<STRING>>, `свои` ARRAY<STRUCT<id: STRING, name: STRING, steps: ARRAY<STRING>>>"


def added_cases(cases: DataFrame, new: DataFrame, cap: int = CASES) -> DataFrame:
    """store_id, ord, id, title, tlp, active: a store's new case (one row for a store) is its last and active; beyond the cap the oldest go."""
    last = cases.groupBy("store_id").agg(F.max("ord").alias("_last"))
    rows = new.join(last, "store_id", "left").select("store_id", (F.coalesce("_last", F.lit(-1)) + 1).alias("ord"), "id", "title", "tlp", F.lit(True).alias("active"))
    old = cases.join(new.select("store_id", F.lit(True).alias("_new")), "store_id", "left").withColumn("active", F.col("active") & F.col("_new").isNull())
    return newest(old.select(*rows.columns).unionByName(rows), ["store_id"], "ord", cap)


def removed_cases(cases: DataFrame, gone: DataFrame) -> DataFrame:
    """The cases without those named (store_id, id); where the active one went, the store's first case is active."""
    marked = cases.join(gone.select("store_id", "id", F.lit(True).alias("_gone")).distinct(), ["store_id", "id"], "left")
    lost = F.max(F.col("active") & F.col("_gone").isNotNull()).over(Window.partitionBy("store_id"))
    left = marked.withColumn("_lost", lost).filter("_gone is null")
    first = F.row_number().over(Window.partitionBy("store_id").orderBy("ord")) == 1
    return left.withColumn("active", F.col("active") | (F.col("_lost") & first)).select(*cases.columns)


def activated(cases: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen case (store_id, id; one row for a store) is active; an id that the store lacks changes nothing."""
    named = cases.join(chosen.select("store_id", F.col("id").alias("_id")), "store_id", "left")
    there = F.max(F.coalesce(F.col("id") == F.col("_id"), F.lit(False))).over(Window.partitionBy("store_id"))
    return named.withColumn("_there", there).withColumn("active", F.when(F.col("_there"), F.col("id") == F.col("_id")).otherwise(F.col("active"))).select(*cases.columns)


def updated_cases(cases: DataFrame, patches: DataFrame) -> DataFrame:
    """Titles (trimmed) and levels of patches (store_id, id, title, tlp; one row for a case): a null leaves what was, an empty level too."""
    rows = patches.select("store_id", "id", F.col("title").alias("_title"), F.col("tlp").alias("_tlp"))
    out = cases.join(rows, ["store_id", "id"], "left")
    return out.withColumn("title", F.coalesce(F.trim("_title"), "title")).withColumn("tlp", F.coalesce(F.nullif("_tlp", F.lit("")), "tlp")).select(*cases.columns)


def case_label(title: Column, items: Column) -> Column:
    """A case in a list: its title or that it has none, and how many indicators it holds."""
    return F.concat(F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit("untitled")), F.lit(" ("), items.cast("string"), F.lit(")"))


def written_filters(stored: DataFrame, new: DataFrame, cap: int = FILTERS) -> DataFrame:
    """case_id, tactic, platform, png, updated: new rows (one for a case) take the place of stored ones, a null png keeps the old one's; beyond the cap
    of a profile the ones written longest ago go."""
    old = stored.select("profile", "case_id", F.struct("tactic", "platform", "png", "updated").alias("_o"))
    both = old.join(new.select("profile", "case_id", F.struct("tactic", "platform", "png", "updated").alias("_n")), ["profile", "case_id"], "full_outer")
    one = F.coalesce("_n", "_o")
    png = F.coalesce(F.col("_n.png"), F.col("_o.png"), F.lit(""))
    rows = both.select("profile", "case_id", one["tactic"].alias("tactic"), one["platform"].alias("platform"), png.alias("png"), one["updated"].alias("updated"))
    rank = F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("updated"), "case_id"))
    return rows.withColumn("_r", rank).filter(F.col("_r") <= cap).drop("_r")


def pruned_filters(stored: DataFrame, cases: DataFrame) -> DataFrame:
    """The filters of cases that there still are."""
    return stored.join(cases.select("case_id").distinct(), "case_id", "left_semi")


def triage_queue(raw: DataFrame) -> DataFrame:
    """id, ord, type, label, value, flags, source, seen, n of a stored queue: rows without type or value are left out, what is missing gets its default."""
    rows = raw.select("id", F.posexplode(F.from_json("raw", TRIAGE)["items"]).alias("ord", "i"))
    kept = rows.filter((F.coalesce("i.value", F.lit("")) != "") & (F.coalesce("i.type", F.lit("")) != ""))
    text = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), other)
    return kept.select(
        "id", "ord", "i.type", text("i.typeLabel", F.col("i.type")).alias("label"), "i.value", F.coalesce("i.flags", F.array().cast("array<string>")).alias("flags"), F.coalesce("i.source", F.lit("")).alias("source"),
        text("i.seenAt", F.lit(EPOCH)).alias("seen"), F.when(F.col("i.count") > 0, F.col("i.count").cast("long")).otherwise(1).alias("n"),
    )


def dismissed_values(raw: DataFrame) -> DataFrame:
    """id, key, t of what a stored queue dismissed."""
    rows = raw.select("id", F.explode(F.from_json("raw", TRIAGE)["dismissed"]).alias("d"))
    return rows.filter(F.coalesce("d.k", F.lit("")) != "").select("id", F.col("d.k").alias("key"), F.coalesce(F.nullif("d.t", F.lit("")), F.lit(EPOCH)).alias("t"))


def steps_of(c: Column) -> Column:
    """Service ids trimmed, without blank and repeated ones."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False))))


def check_list(raw: DataFrame) -> DataFrame:
    """id, name, steps, configured, notes of a stored check list. Of the first version's several lists the common one stays, else the first; the notes say
    what was dropped, and whether the file is unreadable or newer than this reader. No file is an empty list without a note."""
    c = F.from_json("raw", CHECKS)
    rows = raw.select("id", "raw", c.alias("c")).withColumn("many", F.filter("c.`свои`", lambda p: p.isNotNull()))
    old = F.col("c.`набор`").isNull() & F.col("many").isNotNull()
    common = F.get(F.filter("many", lambda p: F.trim(p["id"]) == OWN_ID), F.lit(0))
    taken = F.coalesce(common, F.get("many", F.lit(0)))
    named = F.coalesce(F.nullif(F.trim(taken["name"]), F.lit("")), F.lit(OWN_NAME))
    name = F.when(old & taken.isNotNull(), named).otherwise(F.coalesce(F.trim(F.col("c.`набор`.name")), F.lit("")))
    steps = steps_of(F.when(old, taken["steps"]).otherwise(F.col("c.`набор`.steps")))
    form = F.regexp_extract(F.trim("raw"), r"\A(.)", 1)
    notes = F.array(
        F.when((form != "{") & (F.trim("raw") != "null"), F.lit("unreadable: an empty list is taken")),
        F.when(F.col("c.`версия`") > VERSION, F.lit("a newer version: unknown fields are dropped")),
        F.when(old & (F.size("many") > 1), F.concat(F.lit("other lists dropped: "), (F.size("many") - 1).cast("string"))),
    )
    return rows.select("id", name.alias("name"), steps.alias("steps"), (F.size(steps) > 0).alias("configured"), F.filter(notes, lambda x: x.isNotNull()).alias("notes"))


def saved_list(name: Column, steps: Column) -> Column:
    """A check list as it is stored; an empty one is what clearing leaves."""
    return F.to_json(F.struct(F.lit(VERSION).alias("версия"), F.struct(F.coalesce(F.trim(name), F.lit("")).alias("name"), steps_of(steps).alias("steps")).alias("набор")))


def ordered_sites(sites: DataFrame, language: str) -> DataFrame:
    """Adds place: a profile's sites in their order; for readers of other languages the Russian ones come after the others."""
    last = F.lit(0) if language == "ru" else F.coalesce("russian", F.lit(False)).cast("int")
    return sites.withColumn("place", F.row_number().over(Window.partitionBy("profile").orderBy(last, "ord")))


def capture_status(sessions: DataFrame, reason: str | None = None) -> DataFrame:
    """id, now, end: a capture session in words while it runs, and once it has stopped and why."""
    text = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    now = F.concat(F.lit("capturing this tab · pages "), text("pages"), F.lit(" · queued "), text("added"))
    end = F.concat(F.lit(f"capture stopped ({reason or 'by the user'}): pages "), text("pages"), F.lit(", found "), text("found"), F.lit(", queued "), text("added"))
    return sessions.select("id", now.alias("now"), end.alias("end"))


def without_address(entries: DataFrame) -> DataFrame:
    """har_id, problem: how many entries of an archive name no server address."""
    bare = F.count_if(F.coalesce("ip", F.lit("")) == "")
    return entries.groupBy("har_id").agg(bare.alias("n")).filter("n > 0").select("har_id", F.concat(F.col("n").cast("string"), F.lit(" entries have no server address")).alias("problem"))


#: Addresses opened at once, and the milliseconds before the next ones.
AT_ONCE, PAUSE = 5, 400


def batched(steps: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds batch and wait (milliseconds from the start) to addresses that are to be opened in order, a few at a time."""
    batch = F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1) / AT_ONCE).cast("int")
    return steps.withColumn("batch", batch).withColumn("wait", F.col("batch") * PAUSE)

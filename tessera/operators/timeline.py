"""A case's event log: merging, caps, summaries, unsaved work; and the triage queue in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAP, MERGE_SECONDS, QUEUE, DISMISS_DAYS = 400, 120, 300, 30
MERGEABLE = ("ioc.added", "verdict.set", "verdict.source", "note.set")
CHANGES = ("case.started", "ioc.added", "ioc.removed", "verdict.set", "verdict.source", "note.set")
EXPORT = "export.done"
TRUNCATED = "timeline.truncated"


def micros(t: Column | str) -> Column:
    """Microseconds of a time with or without a zone; differences are what counts."""
    return F.unix_micros((F.col(t) if isinstance(t, str) else t).cast("timestamp"))


def merge_key() -> Column:
    return F.when(F.col("kind") == "ioc.added", F.coalesce("source", F.lit(""))).otherwise(F.coalesce(F.col("value"), F.lit("")))


def merged(events: DataFrame) -> DataFrame:
    """case_id, t, kind, value, count of merged events: neighbours of one kind and key at most two minutes apart become one at the later
    time, counts of additions summed. A verdict that returns to where it began is left as one event here; folded() drops it."""
    w = Window.partitionBy("case_id").orderBy("t", "ord")
    key = F.when(F.col("kind").isin(*MERGEABLE), F.concat_ws("\x1f", "kind", merge_key()))
    gap = micros("t") - micros(F.lag("t").over(w)) <= MERGE_SECONDS * 1_000_000
    again = F.coalesce((key == F.lag(key).over(w)) & gap, F.lit(False))
    runs = events.withColumn("_new", (~again).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("case_id", "_run").agg(
        F.max("t").alias("t"), F.first("kind").alias("kind"), F.max_by("value", "ord").alias("value"),
        F.when(F.first("kind") == "ioc.added", F.sum("count")).otherwise(F.max_by("count", "ord")).alias("count"),
    ).drop("_run")


def folded(events: DataFrame) -> DataFrame:
    """The same with the drop of verdicts that return to their start, as an ordered fold over each case's log: an event meets the last one that is left."""
    e = F.array_sort(F.collect_list(F.struct("t", "ord", "kind", merge_key().alias("key"), "value", "count", "from", "to")))
    logs = events.groupBy("case_id").agg(e.alias("log"))
    start = F.slice(F.col("log"), 1, 0)

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        near = micros(x["t"]) - micros(last["t"]) <= MERGE_SECONDS * 1_000_000
        same = F.coalesce((last["kind"] == x["kind"]) & (last["key"] == x["key"]) & x["kind"].isin(*MERGEABLE) & near, F.lit(False))
        head = F.slice(done, F.lit(1), F.size(done) - 1)
        both = x.withField("count", F.when(x["kind"] == "ioc.added", F.coalesce(last["count"], F.lit(0)) + F.coalesce(x["count"], F.lit(0))).otherwise(x["count"]))
        both = both.withField("from", F.when(x["kind"] == "verdict.set", last["from"]).otherwise(x["from"]))
        back = (x["kind"] == "verdict.set") & F.coalesce(last["from"] == x["to"], F.lit(False))
        return F.when(same & back, head).when(same, F.concat(head, F.array(both))).otherwise(F.concat(done, F.array(x)))

    out = logs.select("case_id", F.posexplode(F.aggregate("log", start, step)).alias("n", "e"))
    return out.select("case_id", "n", "e.t", "e.kind", "e.value", "e.count", "e.from", "e.to")


def capped(events: DataFrame, cap: int = CAP) -> DataFrame:
    """The last events of each case; where some go, a first record says how many."""
    w = Window.partitionBy("case_id").orderBy(F.desc("t"), F.desc("ord"))
    ranked = events.select("case_id", "t", "ord", "kind").withColumn("r", F.row_number().over(w))
    total = events.groupBy("case_id").agg(F.count("*").alias("total"))
    kept = ranked.join(total, "case_id").filter((F.col("total") <= cap) | (F.col("r") <= cap - 1))
    record = kept.filter(F.col("total") > cap).groupBy("case_id").agg(F.min("t").alias("t"), (F.first("total") - (cap - 1)).alias("n"))
    return kept.select("case_id", "t", "kind", F.lit(None).cast("long").alias("n")).unionByName(record.select("case_id", "t", F.lit(TRUNCATED).alias("kind"), "n"))


def work(events: DataFrame) -> DataFrame:
    """What was done in each case."""
    count = lambda k: F.count_if(F.col("kind") == k)
    total = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("count"))), F.lit(0))
    return events.groupBy("case_id").agg(
        F.count("*").alias("events"), count("source.parsed").alias("sources"), total("ioc.added").alias("added"), count("verdict.set").alias("verdicts"), count("playbook.run").alias("playbooks"),
        total("tools.opened").alias("opened"), count(EXPORT).alias("exports"), F.min("t").alias("first"), F.max("t").alias("last"),
    )


def unsaved(events: DataFrame, now: Column) -> DataFrame:
    """Changes since a case's last export, hours since the first of them, and whether to remind; the order of events doesn't matter."""
    good = events.filter("t is not null")
    out = good.filter(F.col("kind") == EXPORT).groupBy("case_id").agg(F.max("t").alias("exported"))
    change = good.filter(F.col("kind").isin(*CHANGES)).join(out, "case_id", "left").filter("exported is null or t > exported")
    open_ = change.groupBy("case_id").agg(F.count("*").alias("changes"), F.min("t").alias("since"))
    hours = F.greatest(F.lit(0.0), (micros(now) - micros("since")) / 3.6e9)
    all_ = good.select("case_id").distinct().join(out, "case_id", "left").join(open_, "case_id", "left").withColumn("changes", F.coalesce("changes", F.lit(0))).withColumn("hours", hours)
    due = (F.col("changes") > 0) & ((F.col("hours") >= 2) | (F.col("changes") >= 20))
    return all_.withColumn("remind", F.coalesce(due, F.lit(False))).withColumn("urgent", F.coalesce(due & ((F.col("hours") >= 24) | (F.col("changes") >= 50)), F.lit(False)))


def by_day(events: DataFrame) -> DataFrame:
    return events.groupBy("case_id", F.to_date("t").alias("day")).agg(F.count("*").alias("events"))


def key(type_: str = "type", value: str = "value") -> Column:
    return F.concat_ws("|", type_, F.lower(value))


def triaged(found: DataFrame, dismissed: DataFrame, in_case: DataFrame, now: Column, cap: int = QUEUE) -> DataFrame:
    """The queue after a batch of finds (queue, ord, type, value, seen): without those in the case or dismissed within thirty days,
    repeats counted, the oldest beyond the cap dropped. `dropped` says how many went."""
    fresh = dismissed.filter(F.col("t") >= now - F.expr(f"interval {DISMISS_DAYS} days")).select("queue", "k")
    own = found.withColumn("k", key()).join(fresh, ["queue", "k"], "left_anti").join(in_case.select("queue", key().alias("k")), ["queue", "k"], "left_anti")
    one = own.groupBy("queue", "k").agg(F.count("*").alias("n"), F.min("ord").alias("ord"), F.max("seen").alias("seen"))
    w = Window.partitionBy("queue")
    ranked = one.withColumn("_r", F.row_number().over(w.orderBy(F.desc("ord")))).withColumn("dropped", F.greatest(F.lit(0), F.count("*").over(w) - cap))
    return ranked.filter(F.col("_r") <= cap).drop("_r")


def undecided(items: DataFrame) -> DataFrame:
    """Items with what still asks for a decision."""
    why = F.array_compact(F.array(
        F.when((F.coalesce("verdict", F.lit("unknown")) != "unknown") & (F.trim(F.coalesce("verdict_source", F.lit(""))) == ""), "no source"),
        F.when(F.coalesce("from_image", F.lit(False)), "from image"), F.when(F.array_contains("flags", "ambiguous:refang"), "guessed"),
    ))
    return items.withColumn("reasons", why).filter(F.size("reasons") > 0)


def verdicts(items: DataFrame) -> DataFrame:
    names = ["malicious", "suspicious", "clean", "irrelevant", "unknown"]
    return items.groupBy("case_id").agg(*[F.count_if(F.coalesce("verdict", F.lit("unknown")) == v).alias(v) for v in names])


def added(case: DataFrame, new: DataFrame) -> DataFrame:
    """The case's items with the new ones that it doesn't hold, the first of equals."""
    one = new.withColumn("_k", key()).groupBy("case_id", "_k").agg(F.min_by(F.struct("type", "value"), "ord").alias("x")).select("case_id", "_k", "x.type", "x.value")
    fresh = one.join(case.select("case_id", key().alias("_k")), ["case_id", "_k"], "left_anti")
    return case.select("case_id", "type", "value", F.lit(False).alias("new")).unionByName(fresh.select("case_id", "type", "value", F.lit(True).alias("new")))


def novelty(found: DataFrame, case: DataFrame) -> DataFrame:
    known = case.select("case_id", key().alias("_k")).distinct().withColumn("_in", F.lit(True))
    return found.withColumn("_k", key()).join(known, ["case_id", "_k"], "left").groupBy("case_id").agg(F.count_if(F.col("_in").isNotNull()).alias("known"), F.count_if(F.col("_in").isNull()).alias("new"))

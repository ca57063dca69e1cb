"""A catalogue of techniques: lookup, search, coverage, matrix, layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERDICTS = ("malicious", "suspicious", "clean", "irrelevant", "unknown")
# The layer's colours.
COLOURS = {"malicious": "#d94f4f", "suspicious": "#d29922", "clean": "#3fb950", "irrelevant": "#6b7787"}


def technique_id(c: str) -> F.Column:
    x = F.regexp_replace(F.replace(F.upper(F.trim(c)), F.lit("/"), F.lit(".")), r"\.$", "")
    return F.when(x.rlike(r"\AT\d{4}(?:\.\d{3})?\z"), x)


def looked_up(items: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Adds name, parent and whether the technique is known; the catalogue has about a thousand rows and AQE broadcasts it."""
    own = items.withColumn("technique", technique_id("value"))
    known = catalogue.select(F.col("id").alias("technique"), "name")
    parent = F.when(F.contains(F.col("technique"), F.lit(".")), F.substring_index("technique", ".", 1))
    return own.join(known, "technique", "left").withColumn("parent", parent).withColumn("known", F.col("name").isNotNull())


def searched(catalogue: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """Exact id, then ids that begin so, then names that hold the text, short names first."""
    q = text.strip()
    rank = F.when(F.lower("id") == q.lower(), 0).when(F.lower("id").startswith(q.lower()), 1).when(F.contains(F.lower("name"), F.lit(q.lower())), 2)
    return catalogue.withColumn("rank", rank).filter("rank is not null").orderBy("rank", F.when(F.col("rank") == 2, F.length("name")).otherwise(0), "id").limit(limit).select("id", "name", "rank")


def _case(items: DataFrame) -> DataFrame:
    """The first item of each technique of each case."""
    own = items.filter(F.col("type") == "attack").withColumn("id", technique_id("value")).filter("id is not null")
    return own.groupBy("case_id", "id").agg(F.min_by(F.coalesce("verdict", F.lit("unknown")), "ord").alias("verdict"), F.min("ord").alias("ord"))


def coverage(items: DataFrame, catalogue: DataFrame) -> DataFrame:
    """case_id, tactic, counts by verdict: a technique counts in each of its tactics."""
    rows = _case(items).join(catalogue.select("id", F.explode("tactics").alias("tactic")), "id")
    return rows.groupBy("case_id", "tactic").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])


def overall(items: DataFrame, catalogue: DataFrame) -> DataFrame:
    """case_id, known, unknown_ids: a technique counts once, whatever its tactics."""
    own = _case(items).join(catalogue.select("id", F.lit(True).alias("_k")), "id", "left")
    return own.groupBy("case_id").agg(F.count_if(F.col("_k").isNotNull()).alias("known"), F.count_if(F.col("_k").isNull()).alias("unknown_ids"))


def matrix(items: DataFrame, catalogue: DataFrame) -> DataFrame:
    """case_id, tactic, id, dimmed: base techniques that the case has, or has through a sub-technique (dimmed)."""
    own = _case(items).withColumn("base", F.substring_index("id", ".", 1))
    base = own.groupBy("case_id", "base").agg(F.bool_or(F.col("id") == F.col("base")).alias("own"))
    tactics = catalogue.select(F.col("id").alias("base"), F.explode("tactics").alias("tactic"))
    return base.join(tactics, "base").select("case_id", "tactic", F.col("base").alias("id"), (~F.col("own")).alias("dimmed"))


def legend(items: DataFrame, catalogue: DataFrame) -> DataFrame:
    """case_id, counts by verdict of the techniques that a case's matrix shows: each counts once, whatever its tactics, and one that only its
    sub-techniques brought in counts as unknown."""
    own = _case(items).select("case_id", "id", "verdict")
    shown = matrix(items, catalogue).select("case_id", "id").distinct()
    bases = shown.join(own, ["case_id", "id"], "left").select("case_id", "id", F.coalesce("verdict", F.lit("unknown")).alias("verdict"))
    parts = own.filter(F.contains("id", F.lit("."))).withColumn("base", F.substring_index("id", ".", 1)).join(catalogue.select("id"), "id").join(shown.withColumnRenamed("id", "base"), ["case_id", "base"])
    return bases.unionByName(parts.select(*bases.columns)).groupBy("case_id").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])


def layer(items: DataFrame, client: bool = False) -> DataFrame:
    """case_id, techniques: the enterprise techniques of a case for a matrix viewer, first ones win, comments left out in client mode."""
    own = items.filter(F.col("type") == "attack").withColumn("id", technique_id("value")).filter("id is not null and not startswith(id, 'T0')")
    first = own.groupBy("case_id", "id").agg(F.min_by(F.struct("verdict", "note"), "ord").alias("f"), F.min("ord").alias("ord"))
    colour = F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])
    comment = F.lit(None).cast("string") if client else F.nullif(F.col("f.note"), F.lit(""))
    one = F.struct(F.col("ord"), F.struct(F.col("id").alias("techniqueID"), F.try_element_at(colour, F.col("f.verdict")).alias("color"), comment.alias("comment")).alias("t"))
    rows = first.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]).alias("techniques"))
    head = [F.lit("4.5").alias("version"), F.lit("enterprise-attack").alias("domain")]
    return rows.select("case_id", F.size("techniques").alias("n"), F.to_json(F.struct(*head, "techniques")).alias("layer"))


def ranked_packs(pack: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """Names that are, begin with, or whose categories hold the text; two characters at least."""
    q = text.strip().lower()
    if len(q) < 2:
        return pack.limit(0).select("name", F.lit(0).alias("rank"))
    rank = F.when(F.lower("name") == q, 0).when(F.lower("name").startswith(q), 1).when(F.exists("categories", lambda c: F.contains(F.lower(c), F.lit(q))), 2)
    return pack.withColumn("rank", rank).filter("rank is not null").orderBy("rank", "name").limit(limit).select("name", "rank")


def pack_lookup(files: DataFrame, pack: DataFrame) -> DataFrame:
    """A file's pack entry: by its name, else by its name without the ending."""
    base = F.lower(F.regexp_extract("path", r"([^\\/]+)$", 1))
    own = files.withColumn("_a", base).withColumn("_b", F.regexp_replace(base, r"\.[^.]+$", ""))
    by = lambda k, n: pack.groupBy(F.lower("key").alias(k)).agg(F.min("name").alias(n))
    return own.join(by("_a", "_n"), "_a", "left").join(by("_b", "_m"), "_b", "left").withColumn("entry", F.coalesce("_n", "_m")).drop("_a", "_b", "_n", "_m")


def folded_binaries(raw: DataFrame) -> DataFrame:
    """name, categories, techniques of a list of binaries (Name, Commands), each sorted; fewer than fifty names are no such list."""
    rows = raw.select(F.col("Name").alias("name"), F.explode_outer("Commands").alias("c"))
    return rows.groupBy("name").agg(F.array_sort(F.collect_set("c.Category")).alias("categories"), F.array_sort(F.collect_set("c.MitreID")).alias("techniques"))


def ordinal(df: DataFrame, by: list[str], order: str) -> F.Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(order))


# The fields of a catalogue file.
CATALOGUE = "techniques MAP<STRING, ARRAY<STRING>>, tactics ARRAY<STRING>, attack STRUCT<`версия`: STRING, `собрано`: STRING>"


def catalogue_of(raw: DataFrame) -> DataFrame:
    """id, name, tactics of a catalogue file ({techniques: {id: [name, [numbers of tactics], ...]}, tactics}); a file of another form is an error."""
    read = raw.select(F.from_json("raw", CATALOGUE).alias("c"))
    sound = F.col("c.techniques").isNotNull() & F.col("c.tactics").isNotNull()
    rows = read.select(F.explode(F.when(sound, F.col("c.techniques")).otherwise(F.raise_error(F.lit("no catalogue of techniques")))).alias("id", "entry"), "c.tactics")
    numbers = F.from_json(F.get("entry", F.lit(1)), "ARRAY<INT>")
    named = F.filter(F.transform(F.coalesce(numbers, F.array().cast("array<int>")), lambda k: F.get("tactics", k)), lambda t: t.isNotNull())
    return rows.select("id", F.get("entry", F.lit(0)).alias("name"), named.alias("tactics"))


def catalogue_summary(raw: DataFrame) -> DataFrame:
    """entries, tactics, version, built of a catalogue file; version and date are null where the file has none."""
    read = raw.select(F.from_json("raw", CATALOGUE).alias("c")).filter(F.col("c.techniques").isNotNull())
    return read.select(F.size(F.map_keys("c.techniques")).alias("entries"), F.coalesce(F.size("c.tactics"), F.lit(0)).alias("tactics"), F.col("c.attack.`версия`").alias("version"), F.col("c.attack.`собрано`").alias("built"))


def technique_facts(items: DataFrame, catalogue: DataFrame, column: str) -> DataFrame:
    """The items' columns, name, value: a technique's name, tactics and parent, or that the catalogue has no such technique."""
    of = catalogue.select("id", "name", F.array_join("tactics", ", ").alias("tactics"))
    side = lambda key: of.select(F.col("id").alias(key), F.col("name").alias(f"{key}_name"), F.col("tactics").alias(f"{key}_tactics"))
    own = items.withColumn("_t", technique_id(column)).withColumn("_p", F.when(F.contains(F.col("_t"), F.lit(".")), F.substring_index("_t", ".", 1)))
    own = own.join(side("_t"), "_t", "left").join(side("_p"), "_p", "left")
    fact = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("name"), value.alias("value")))
    known = F.array(fact("technique", F.col("_t_name")), fact("tactics", F.nullif("_t_tactics", F.lit(""))), fact("parent", F.concat("_p", F.lit(" — "), "_p_name")))
    rows = F.when(F.col("_t_name").isNotNull(), F.filter(known, lambda f: f.isNotNull())).otherwise(F.array(fact("warning", F.lit("no such technique"))))
    return own.select(*items.columns, F.inline(rows))


def cell(c: Column) -> Column:
    """A value as a cell of a Markdown table."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " "))


def _lines(rows: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(rows), lambda x: x["line"]), "\n")


def coverage_markdown(items: DataFrame, catalogue: DataFrame, order: list[str], client: bool = False) -> DataFrame:
    """case_id, text: a report's section on techniques: counts, a table by tactic, a table of techniques, and ids that the catalogue lacks.

    Tactics stand in the given order, others after them by name. In client mode the columns of who checked and what was seen are not made at all.
    Every list is bound by the catalogue and the case.
    """
    own = items.filter(F.col("type") == "attack").withColumn("id", technique_id("value")).filter("id is not null")
    verdict = F.when(F.col("f.verdict").isin(*VERDICTS), F.col("f.verdict")).otherwise("unknown")
    first = own.groupBy("case_id", "id").agg(F.min_by(F.struct("verdict", "verdict_source", "note"), "ord").alias("f")).select("case_id", "id", verdict.alias("v"), F.col("f.verdict_source").alias("checked"), F.col("f.note").alias("note"))
    rows = first.join(catalogue.select("id", "name", "tactics"), "id", "left")
    text = lambda c: c.cast("string")
    many = lambda v: F.count_if(F.col("v") == v)
    found = F.count_if(F.col("name").isNotNull())
    counts = F.concat_ws(" · ", *[F.when(many(v) > 0, F.concat(F.lit(f"{v}: "), text(many(v)))) for v in VERDICTS])
    head = F.concat(F.lit("> Techniques in the case: **"), text(F.count("*")), F.lit("**"), F.when(found != F.count("*"), F.concat(F.lit(" (in the catalogue: "), text(found), F.lit(")"))).otherwise(""), F.lit(". "), counts, F.lit("."))
    open_ = F.when(many("unknown") > 0, F.concat(F.lit("\n>\n> **Not checked: "), text(many("unknown")), F.lit("**"))).otherwise("")
    missing = F.array_sort(F.collect_list(F.when(F.col("name").isNull(), F.concat(F.lit("`"), "id", F.lit("`")))))
    tail = F.when(F.size(missing) > 0, F.concat(F.lit("\n\n> Not in the catalogue: "), F.array_join(missing, ", "))).otherwise("")
    cases = rows.groupBy("case_id").agg(F.concat(head, open_).alias("head"), tail.alias("tail"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("tactic"))
    flat = rows.filter("name is not null").withColumn("tactic", F.explode(F.when(F.size("tactics") > 0, F.col("tactics")).otherwise(F.array(F.lit("—")))))
    flat = flat.withColumn("at", F.when(place > 0, place).otherwise(len(order) + 1))
    line = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *c), F.lit(" |")).alias("line")
    link = F.concat(F.lit("["), cell(F.col("name")), F.lit("](https://attack.mitre.org/techniques/"), F.replace("id", F.lit("."), F.lit("/")), F.lit("/)"))
    last = [] if client else [F.coalesce(F.nullif(cell(F.col(c)), F.lit("")), F.lit("—")) for c in ("checked", "note")]
    each = F.collect_list(F.struct("at", "tactic", "id", line(cell(F.col("tactic")), F.concat(F.lit("`"), "id", F.lit("`")), link, F.col("v"), *last)))
    by = flat.groupBy("case_id", "at", "tactic").agg(line(cell(F.col("tactic")), text(F.count("*")), text(many("malicious")), text(many("suspicious")), text(many("unknown"))))
    sums = by.groupBy("case_id").agg(_lines(F.collect_list(F.struct("at", "tactic", "line"))).alias("sums"))
    details = flat.groupBy("case_id").agg(_lines(each).alias("details"))
    titles = ["Tactic", "ID", "Technique", "Verdict", *([] if client else ["Checked with", "Observation"])]
    top = "\n\n| Tactic | Techniques | Malicious | Suspicious | Not checked |\n|---|---:|---:|---:|---:|\n"
    mid = f"\n\n| {' | '.join(titles)} |\n|{'---|' * len(titles)}\n"
    tables = F.when(F.col("sums").isNotNull(), F.concat(F.lit(top), "sums", F.lit(mid), "details")).otherwise("")
    return cases.join(sums, "case_id", "left").join(details, "case_id", "left").select("case_id", F.concat("head", tables, "tail").alias("text"))

"""Relations among the indicators of a case, and chains of redirects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .noise import suffixes
from .tables import saved

ENOUGH = 11


def nodes(items: DataFrame) -> DataFrame:
    """case_id, key, type, value, verdict: the first item of each value."""
    own = items.filter("value is not null and value <> ''").withColumn("key", F.lower("value"))
    first = own.groupBy("case_id", "key").agg(F.min_by(F.struct("type", "value", "verdict"), "ord").alias("f"))
    return first.select("case_id", "key", "f.type", "f.value", F.coalesce("f.verdict", F.lit("unknown")).alias("verdict"))


def edges(items: DataFrame) -> DataFrame:
    """case_id, from, to, kind: item to source; address to host, mail to domain, domain to its nearest parent, IPv4 to network."""
    n = nodes(items)
    source = items.filter("trim(source) <> ''").select("case_id", F.lower("value").alias("from"), F.concat(F.lit("s:"), F.trim("source")).alias("to"), F.lit("from-source").alias("kind")).distinct()
    keys = n.select("case_id", F.col("key").alias("to"))
    of = lambda t, key: n.filter(F.col("type") == t).select("case_id", F.col("key").alias("from"), key.alias("to")).join(keys, ["case_id", "to"]).filter("from <> to")
    part = of("url", T.url_host("value")).unionByName(of("email", F.lower(F.regexp_extract("value", r"@([^@\s]+)$", 1))))
    above = n.filter(F.col("type").isin("domain", "onion")).select("case_id", F.col("key").alias("from"), F.posexplode(suffixes(F.col("key"))).alias("k", "to"), F.size(F.split("key", r"\.")).alias("labels"))
    above = above.filter("k > 0 and k < labels - 1").join(keys, ["case_id", "to"]).groupBy("case_id", "from").agg(F.min_by("to", "k").alias("to"))
    v4 = n.filter(F.col("type") == "ipv4").select("case_id", F.col("key").alias("from"), T.ipv4_number("value").alias("ip"))
    net = n.filter(F.col("type") == "cidr").select("case_id", F.col("key").alias("to"), T.ipv4_number(F.substring_index("value", "/", 1)).alias("base"), F.substring_index("value", "/", -1).cast("int").alias("bits"))
    net = net.withColumn("size", F.pow(F.lit(2.0), 32 - F.col("bits")).cast("long"))
    # Networks are joined by their /8 block, or the sixteen-million-address blocks they span, not against each address.
    net = net.withColumn("block", F.explode(F.sequence(F.expr("(base - base % size) div 16777216"), F.expr("(base - base % size + size - 1) div 16777216"))))
    holds = v4.withColumn("block", F.expr("ip div 16777216")).join(net, ["case_id", "block"]).filter("ip - ip % size = base - base % size").select("case_id", "from", "to")
    inner = part.select("case_id", "from", "to").unionByName(above.select("case_id", "from", "to")).unionByName(holds).withColumn("kind", F.lit("part-of")).distinct()
    return source.unionByName(inner)


def shown(items: DataFrame) -> DataFrame:
    """case_id, total, enough: a graph is drawn from eleven indicators on."""
    return nodes(items).groupBy("case_id").agg(F.count("*").alias("total")).withColumn("enough", F.col("total") >= ENOUGH)


def chains(links: DataFrame) -> DataFrame:
    """start, step, url: chains of redirects from addresses that nothing leads to, followed until they end or come round.

    `links` has url, target, ord; the last target of an address counts. By doubling: the walks of 2 ** k steps are carried on by jumps of 2 ** k steps, so
    the rounds grow with the logarithm of the longest chain, which has no bound. An address has one target, so behind one that comes round all come round:
    the first step at which a chain meets an address is all that has to be kept. Rows without an address or a target lead nowhere.
    """
    moves = links.filter("url is not null and target is not null and target <> '' and target <> url").groupBy("url").agg(F.max_by("target", "ord").alias("target"))
    jumps, reach = saved(moves), 1
    starts = jumps.join(jumps.select(F.col("target").alias("url")).distinct(), "url", "left_anti")
    walks = saved(starts.select(F.col("url").alias("start"), F.lit(0).alias("step"), "url"))
    n = walks.count()
    while True:
        on = walks.join(jumps, "url").select("start", (F.col("step") + reach).alias("step"), F.col("target").alias("url"))
        longer = saved(walks.unionByName(on).groupBy("start", "url").agg(F.min("step").alias("step")))
        before, n, walks = n, longer.count(), longer
        if n > before:
            jumps, reach = saved(jumps.join(jumps.select(F.col("url").alias("target"), F.col("target").alias("_next")), "target").select("url", F.col("_next").alias("target"))), 2 * reach
        if n == before or jumps.isEmpty():
            return walks.select("start", "step", "url")

"""Quality rules by document and by host, in DataFrame functions alone.

Method: host-level rules. Each document is measured over its whole text; rule failures are summed by host (`source`), the hosts' failure
rates are shrunk with a beta prior fitted to all hosts by moments, and the hosts' verdicts are joined back to their documents. Hosts of fewer than
HOST_DOCUMENTS documents are judged by the base rules alone: with so few, one of mostly good hosts would lose good documents to chance.

Defined results: null or empty text has no words and fails; a null source is no host and only the base rules judge its documents; repeated
rows each get a row; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
#: A host whose shrunk failure rate is above this loses all its documents: most of what it publishes is junk.
HOST_RATE = 0.5
#: Hosts have to show so many documents before the whole host can be judged.
HOST_DOCUMENTS = 20

_LINE = r"[^\x20\x09-\x0D]"


def measures(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, source and the base measures of each row's whole text, with the columns named in carry.

    Windows of five words are compared by 64-bit hash inside their own document; only documents in which two are equal sort them.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.expr(r"filter(split(_text, '[\\x20\\x09-\\x0D]+', -1), w -> w != '')")
    own = list(dict.fromkeys(["doc_id", "source", *carry]))
    one = docs.select(*own, text.alias("_text")).select(
        *own,
        words.alias("_w"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        F.expr(rf"filter(split(_text, '\n', -1), l -> l rlike '{_LINE.replace(chr(92), chr(92) * 2)}')").alias("_lines"),
    )
    at = ", ".join(f"_w[i + {k}]" for k in range(WINDOW))
    two = one.select(
        *own,
        F.size("_w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.expr("cast(size(_lines) - size(array_distinct(_lines)) as long)").alias("n_dup_lines"),
        F.expr(f"case when size(_w) > {WINDOW} then transform(sequence(0, size(_w) - {WINDOW}), i -> xxhash64({at})) else array() end").alias("_h"),
    )
    three = two.withColumn("_s", F.expr("case when size(array_distinct(_h)) = size(_h) then null else sort_array(transform(_h, (h, i) -> struct(h, i))) end"))
    four = three.withColumn(
        "_at",
        F.expr("""sort_array(transform(filter(transform(_s, (x, j) -> struct(x.i as i, (j > 0 and _s[greatest(j - 1, 0)].h = x.h)
            or (j < size(_s) - 1 and _s[least(j + 1, size(_s) - 1)].h = x.h) as twice)), x -> x.twice), x -> x.i))"""),
    )
    covered = F.expr(f"""case when _at is null then 0L else aggregate(_at, struct(0L as n, -1 as upto),
        (a, i) -> struct(a.n + (i + {WINDOW} - greatest(i, a.upto)) as n, i + {WINDOW} as upto), a -> a.n) end""")
    # A generator stands here so that no filter on the measures moves below it: inlined into each other, they would be evaluated anew for each word.
    all_five = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))
    return four.select(*own, F.inline(F.array(all_five)))


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def host_rates(measured: DataFrame) -> DataFrame:
    """source, n, failed, rate: the rate shrunk to the hosts' common beta distribution.

    The prior's mean is the mean host rate and its strength comes from the variance of the rates beyond binomial noise (method of moments);
    with one host, or no spread beyond noise, hosts shrink to the mean as if they had shown one more document.
    """
    hosts = measured.filter("source is not null").groupBy("source").agg(F.count("*").alias("n"), F.sum(base_failed().cast("long")).alias("failed"))
    hosts = common.save(hosts)
    raw = F.col("failed") / F.col("n")
    m = hosts.agg(F.avg(raw).alias("mean"), F.var_samp(raw).alias("spread"), F.avg(1 / F.col("n")).alias("inverse")).first()
    mean = min(max(m.mean or 0.0, 1e-4), 1 - 1e-4)
    noise = mean * (1 - mean) * (m.inverse or 1.0)
    beyond = max((m.spread or 0.0) - noise, 0.0)
    strength = max(1.0, min(1e6, mean * (1 - mean) / beyond - 1)) if beyond > 0 else 1.0
    return hosts.withColumn("rate", (F.col("failed") + mean * strength) / (F.col("n") + strength))


def judge(docs: DataFrame) -> DataFrame:
    """A row for each document: the base measures, base_failed, host_rate (null: no host) and kept."""
    measured = common.save(measures(docs))
    hosts = common.save(host_rates(measured))
    bad = common.small(hosts.filter((F.col("rate") > HOST_RATE) & (F.col("n") >= HOST_DOCUMENTS)).select("source", F.lit(True).alias("_bad")))
    out = measured.withColumn("base_failed", base_failed()).join(bad, "source", "left")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("_bad").isNull()).alias("kept"), F.col("_bad").isNotNull().alias("host_failed"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, unchanged.

    The base verdict is computed on the row itself, the host's verdict joins on the source, so repeated ids cannot mix. Each text is measured once; the rows
    are written with their measures, without the texts that fail.
    """
    measured = measures(docs, *common.DOCUMENT).withColumn("text", F.when(~base_failed(), F.col("text")))
    measured = common.save(measured)
    hosts = common.save(host_rates(measured))
    bad = common.small(hosts.filter((F.col("rate") > HOST_RATE) & (F.col("n") >= HOST_DOCUMENTS)).select("source"))
    return measured.filter(~base_failed()).join(bad, "source", "left_anti").select(*common.DOCUMENT)

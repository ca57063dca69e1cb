"""What the training-data operators share: shared scratch tables, size-checked broadcasts, skew-safe running sums."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, everywhere in this package: a run without the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: The columns of `documents`.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows in a bucket of running_start(): small, so that a key with a third of all rows still spreads over many tasks.
BUCKET_ROWS = 500
#: Buckets that one window of offsets reads.
FAN = 1000
#: A broadcast side has at most so many bytes, counted from its rows; beyond it the join is a shuffled one.
BROADCAST_BYTES = 24 << 20

_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see. Where that is unset, a session on one machine gets a temporary folder; on a cluster
    that would be another disk for each executor, so there it is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    path = f"{(shared or _own()).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


@lru_cache(maxsize=1)
def _own() -> str:
    return tempfile.mkdtemp(prefix="tessera-")


def save(df: DataFrame, *partition: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and returns the table: lineage ends, and lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.partitionBy(*partition).parquet(path) if partition else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what is written by now; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    for spark, path in _SCRATCH:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone
            break
    if _own.cache_info().currsize:
        shutil.rmtree(_own(), ignore_errors=True)


def size_of(table: DataFrame) -> int:
    """The bytes of a saved table's rows: 16 for a row, 8 for a value, and what texts and lists hold (16 for each item of a list)."""
    total = F.lit(16 + 8 * len(table.columns))
    for name, kind in table.dtypes:
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith(("array", "map")):
            total = total + 16 * F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0))
    return table.agg(F.sum(total.cast("long"))).first()[0] or 0


def small(table: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A saved table with a broadcast hint if its counted bytes are within the bound, else as it is: then the join shuffles."""
    return F.broadcast(table) if size_of(table) <= most else table


def buckets(rows: int) -> int:
    return max(1, -(-rows // BUCKET_ROWS))


def running_start(table: DataFrame, keys: list[str], order: list[str], amount: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `amount` over the earlier rows of the same keys.

    Rows of a key lie in hashed buckets of about BUCKET_ROWS rows; sums go from buckets to groups of FAN buckets to the
    key, so no task sees all the rows of a hot key. The order (bucket, then `order`) is fixed by the rows alone. `table` must be saved,
    for it is read several times; keys must not be null.
    """
    n = buckets(table.count())
    split = table.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(n)))
    sums = split.groupBy(*keys, "_b").agg(F.sum(amount).alias("_n")).withColumn("_g", F.expr(f"_b div {FAN}"))
    groups = sums.groupBy(*keys, "_g").agg(F.sum("_n").alias("_n"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(*keys, "_g", F.coalesce(F.sum("_n").over(before(*keys, "_g")), F.lit(0)).alias("_of_group"))
    sums = sums.select(*keys, "_g", "_b", F.coalesce(F.sum("_n").over(before(*keys, "_g", "_b")), F.lit(0)).alias("_of_bucket"))
    sums = sums.join(groups, [*keys, "_g"]).select(*keys, "_b", (F.col("_of_bucket") + F.col("_of_group")).alias("_of"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = split.withColumn("_own", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return own.join(sums, [*keys, "_b"]).withColumn(out, (F.col("_own") + F.col("_of")).cast("long")).drop("_b", "_own", "_of")


def global_index(df: DataFrame, order: list, out: str) -> DataFrame:
    """Saves df with `out`, its rows' place from 0 in the given order: ranges are sorted apart and their counts summed."""
    ranged = save(df.orderBy(*order).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").count()  # a row for each partition
    starts = counts.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_of"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return save(ranged.withColumn("_own", own).join(starts, "_p").withColumn(out, (F.col("_own") + F.col("_of")).cast("long")).drop("_p", "_own", "_of"))

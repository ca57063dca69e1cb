"""The queries that the entry module offers, each with its SQL twin where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one whose files make fewer tasks than there are cores is dealt to all of them first if its rows are texts or become texts."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages", "customer") and df.rdd.getNumPartitions() < cores else df


def carrier(spark: SparkSession, sf_dir: str, source: str, columns: str) -> DataFrame:
    """Columns made from a table's keys by SQL expressions that both engines read alike."""
    return table(spark, sf_dir, source).selectExpr(*(c.strip() for c in columns.split("\n") if c.strip()))


def select(source: str, columns: str) -> str:
    """The same as SQL text."""
    return f"SELECT {', '.join(c.strip() for c in columns.split(chr(10)) if c.strip())} FROM {source}"

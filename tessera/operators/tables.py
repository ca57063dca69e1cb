"""Written tables: lineage is cut in the folder that all executors share, so a lost executor costs its own tasks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession, kind: str = "table") -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, below a temporary one, but only on one machine: executors don't share theirs."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    base = base or tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The same rows, written and read again."""
    path = shared(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

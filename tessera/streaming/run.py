"""Runs a stream over what is there now, with its checkpoint and output in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.tables import shared


def source(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    """A table's file as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drained(stream: DataFrame, mode: str = "update") -> DataFrame:
    """All that the stream emits until its source is used up; batches that are retried overwrite their own folder."""
    spark, path = stream.sparkSession, shared(stream.sparkSession, "stream")
    put = lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out/batch={n}")
    q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{path}/out").drop("batch")

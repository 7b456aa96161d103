"""Folders for written results, under the folder that the cluster shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.lineage import shared_folder


def folder(spark: SparkSession) -> str:
    """A new, unused path in the shared folder."""
    return shared_folder(spark)


def written(spark: SparkSession, write: Callable[[str], None]) -> DataFrame:
    """Write somewhere new and read it back."""
    path = folder(spark)
    write(path)
    return spark.read.parquet(path)


def sliced(df: DataFrame, at: str, start: int = 1704067200, days: int = 8, parts: int = 4) -> DataFrame:
    """A stream of stored rows that lie in slices of time, one file and one batch each; what comes after the last slice joins it."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    rows = df.withColumn("slice", F.least(F.floor((F.unix_seconds(at) - start) / (days * 86400)), F.lit(parts - 1))).persist()
    for k in range(parts):
        rows.filter(F.col("slice") == k).drop("slice").coalesce(1).write.mode("append").parquet(path)
    rows.unpersist()
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming query over everything available, into files, and return what it wrote."""
    spark = stream.sparkSession
    out, marks = folder(spark), folder(spark)
    if mode == "append":
        q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks)
             .outputMode("append").trigger(availableNow=True).start())
    else:
        def save(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        q = (stream.writeStream.foreachBatch(save).option("checkpointLocation", marks)
             .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)

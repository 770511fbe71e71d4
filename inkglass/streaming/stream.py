"""Inspection of files as they arrive. It is stateless per file, except that files of the same
content may be taken once: by hash, within a watermark on their modification time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkglass.functions import limits
from inkglass.plans.inspect import inspect
from inkglass.sources import files


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.readStream.format("binaryFile").schema(files.SCHEMA).option("recursiveFileLookup", "true").load(path)
    return rows.where(F.col("length").between(1, limits.FILE_BYTES))


def inspect_stream(spark: SparkSession, path: str, sink: str, checkpoint: str, once_per_content: str | None = None):
    """Writes reports of new files to Parquet and ends when there are no more; returns the query.
    once_per_content: the delay within which equal contents are taken once, such as '1 day'."""
    rows = read_stream(spark, path)
    if once_per_content:
        rows = rows.withColumn("sha256", F.sha2("content", 256)).withWatermark("modificationTime", once_per_content).dropDuplicatesWithinWatermark(["sha256"]).drop("sha256")
    out = inspect(files.as_files(rows))
    return out.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)

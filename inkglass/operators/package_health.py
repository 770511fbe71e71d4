"""Health of packages (ZIP directories): duplicates, odd names, ratios, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkglass.functions import limits

ODD_NAME = r"(^/)|(^[A-Za-z]:)|(\\)|((^|/)\.\.(/|$))"


def health(entries: DataFrame) -> DataFrame:
    """Per file_id, of entries (name, flags, compressed, uncompressed): n_entries, n_duplicates,
    n_odd, worst_ratio (of entries with compressed bytes), n_encrypted, declared_total, suspicious."""
    # names are counted in two steps, so one large package is combined before the shuffle
    by_name = entries.groupBy("file_id", "name").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.floor(F.col("uncompressed") / F.when(F.col("compressed") > 0, F.col("compressed")))).alias("ratio"),
        F.count_if(F.col("flags").bitwiseAND(1) != 0).alias("locked"), F.sum("uncompressed").alias("bytes"),
    )
    out = by_name.groupBy("file_id").agg(
        F.sum("n").alias("n_entries"), F.sum(F.col("n") - 1).alias("n_duplicates"), F.sum(F.when(F.col("name").rlike(ODD_NAME), F.col("n")).otherwise(0)).alias("n_odd"),
        F.coalesce(F.max("ratio"), F.lit(0)).cast("long").alias("worst_ratio"), F.sum("locked").alias("n_encrypted"), F.sum("bytes").alias("declared_total"),
    )
    bad = (F.col("n_duplicates") > 0) | (F.col("n_odd") > 0) | (F.col("worst_ratio") > limits.ZIP_RATIO) | (F.col("declared_total") > limits.ZIP_DECLARED)
    return out.withColumn("suspicious", bad)

"""Segment rows as relations: classification by lookup, first of a kind, numbered parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkglass.operators.jpeg import KINDS


def kind_table(spark: SparkSession) -> DataFrame:
    """The table of JPEG segment kinds: a fixed number of rows."""
    return spark.createDataFrame([(m, bytearray(p), k, g, i) for i, (m, p, k, g) in enumerate(KINDS)], "marker int, prefix binary, kind string, grp string, place int")


def classified(segments: DataFrame) -> DataFrame:
    """Segments (file_id, seq, marker, payload) with kind and grp, by a lookup on marker and prefix."""
    found = segments.alias("s").join(F.broadcast(kind_table(segments.sparkSession)).alias("k"), (F.col("s.marker") == F.col("k.marker")) & (F.substring("s.payload", F.lit(1), F.octet_length("k.prefix")) == F.col("k.prefix")), "left")
    other = F.col("s.marker").between(0xE0, 0xEF)
    return found.select("s.*", F.coalesce("k.kind", F.when(other, "app-other").otherwise("structure")).alias("kind"), F.when(F.col("k.kind").isNotNull(), F.col("k.grp")).when(other, "other-segments").alias("grp"))


def is_frame(marker: Column) -> Column:
    return marker.between(0xC0, 0xCF) & ~marker.isin(0xC4, 0xC8, 0xCC)


def first_of_kind(rows: DataFrame, key: str, kind: str, order: str) -> DataFrame:
    """Rows with nth: which of its kind a row is, by order; all but the first are duplicates."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(key, kind).orderBy(order))).withColumn("duplicate", F.col("nth") > 1)


def numbered_parts(parts: DataFrame, key: str, number: str, total: str, size: str, most: int) -> DataFrame:
    """Whether each key's parts can be put together: taken in order until `most` bytes, they are whole
    if they are as many as the first one says and numbered 1 to n. Columns: n, bytes, whole."""
    running = F.sum(size).over(W.partitionBy(key).orderBy(number).rowsBetween(W.unboundedPreceding, W.currentRow))
    taken = parts.withColumn("__sum", running).where(F.col("__sum") <= most)
    return taken.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"),
        ((F.count(F.lit(1)) == F.min_by(total, number)) & (F.min(number) == 1) & (F.max(number) == F.count(F.lit(1))) & (F.count_distinct(number) == F.count(F.lit(1)))).alias("whole"),
    )


def compared_folders(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files (name, content) of two folders by name: same, changed, missing or unexpected."""
    one, two = old.select("name", F.sha2("content", 256).alias("a")), new.select("name", F.sha2("content", 256).alias("b"))
    state = F.when(F.col("a").isNull(), "unexpected").when(F.col("b").isNull(), "missing").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return one.join(two, "name", "full_outer").select("name", state.alias("state"))

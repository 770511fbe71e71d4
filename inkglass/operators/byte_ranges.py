"""Byte ranges of files: how they tile a file, and which of them lie in others.

Ranges are (key, offset, length). Joins are equalities: a range is filed under the one or two aligned
blocks that it meets on the level of its own length (the smallest power of two that isn't shorter), and
a point looks there on each level that ranges have, so no pair is made that doesn't meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tiling(ranges: DataFrame, sizes: DataFrame) -> DataFrame:
    """file_id, kind (hole, overlap, outside), start, stop: what keeps ranges (file_id, offset, length) from tiling files (file_id, size).

    A hole is not in any range, an overlap is the part of a range that is in one that starts before it (or is listed with
    the same start and isn't longer), outside is what lies before the file's start or beyond its end. Cases: ranges without length count for
    nothing; null offsets or lengths are left out; a file without ranges is one hole; ranges of files without a size give no rows.
    Ranges of a file are sorted in one task: walkers list 20,000 at most."""
    inside = ranges.where("length > 0 AND offset IS NOT NULL").select("file_id", F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("stop"))
    # the end of the file is a range of no length, so that a hole before it is seen
    ends = sizes.select("file_id", F.col("size").alias("start"), F.col("size").alias("stop"))
    known = inside.join(sizes.select("file_id", "size"), "file_id").unionByName(ends.withColumn("size", F.col("stop")))
    order = W.partitionBy("file_id").orderBy("start", F.desc("stop"))
    rows = known.withColumn("before", F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1)))
    reached = F.greatest(F.coalesce("before", F.lit(0)), F.lit(0))
    one = lambda when, kind, start, stop: F.when(when, F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("start"), stop.cast("long").alias("stop")))
    start, stop, size = F.col("start"), F.col("stop"), F.col("size")
    # holes end with the file, overlaps may lie outside
    found = F.array_compact(F.array(
        one(F.least(start, size) > reached, "hole", reached, F.least(start, size)),
        one((start < F.col("before")) & (stop > start), "overlap", start, F.least(stop, F.col("before"))),
        one(start < 0, "outside", start, F.least(stop, F.lit(0))),
        one(stop > size, "outside", F.greatest(start, size), stop),
    ))
    return rows.select("file_id", F.explode(found).alias("x")).select("file_id", "x.*")


def islands(ranges: DataFrame) -> DataFrame:
    """file_id, start, stop of what ranges (file_id, offset, length) cover together, touching ones joined."""
    rows = ranges.where("length > 0 AND offset IS NOT NULL").select("file_id", F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("stop"))
    order = W.partitionBy("file_id").orderBy("start", "stop")
    reached = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.coalesce((F.col("start") > reached).cast("int"), F.lit(1)))
    numbered = marked.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return numbered.groupBy("file_id", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def level(length: Column) -> Column:
    """The exponent of the smallest power of two that isn't less."""
    return F.length(F.regexp_replace(F.bin(F.greatest(length, F.lit(1)) - 1), "^0+", "")).cast("int")


def block(point: Column, on: Column) -> Column:
    """The aligned block of 2^on bytes that a point lies in."""
    return F.floor(point / F.pow(F.lit(2.0), on)).cast("long")


def points_inside(points: DataFrame, at: str, spans: DataFrame, start: str, stop: str, by: str) -> DataFrame:
    """Pairs of points and spans with equal `by` and start <= at < stop; their other columns must differ. A task gets what shares
    a block of about a span's length."""
    on = level(F.col(stop) - F.col(start))
    filed = spans.where(F.col(start) < F.col(stop)).withColumn("__level", on)
    filed = filed.withColumn("__block", F.explode(F.array_distinct(F.array(block(F.col(start), F.col("__level")), block(F.col(stop) - 1, F.col("__level"))))))
    levels = spans.where(F.col(start) < F.col(stop)).groupBy(by).agg(F.collect_set(on).alias("__levels"))  # 64 a key at most
    looked = points.join(levels, by).withColumn("__level", F.explode("__levels")).drop("__levels").withColumn("__block", block(F.col(at), F.col("__level")))
    found = looked.join(filed, [by, "__level", "__block"])
    return found.where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(stop))).drop("__level", "__block")


def by_place(findings: DataFrame, removed: DataFrame) -> DataFrame:
    """file_id, seq, covered, state of findings (file_id, seq, offset, length): how many of their bytes lie in removed ranges
    (file_id, offset, length), and if they are `gone` (all), `cut` (some) or `kept`.

    Cases: touching and nested ranges count once. A finding without length is gone where a removed range has its byte. Null
    offsets or lengths are kept. (file_id, seq) must differ."""
    spans = islands(removed).select("file_id", F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
    own = findings.select("file_id", "seq", F.col("offset").cast("long").alias("f_start"), (F.col("offset") + F.col("length")).cast("long").alias("f_stop"))
    named = own.where("f_start IS NOT NULL AND f_stop IS NOT NULL")
    # two stretches meet if one begins in the other; of two that begin together the first join has them
    first = points_inside(named, "f_start", spans, "r_start", "r_stop", "file_id")
    later = points_inside(spans, "r_start", named, "f_start", "f_stop", "file_id").where("r_start > f_start")
    meets = first.unionByName(later).select("file_id", "seq", (F.least("f_stop", "r_stop") - F.greatest("f_start", "r_start")).alias("n"))
    sums = meets.groupBy("file_id", "seq").agg(F.sum("n").alias("covered"))
    both = own.join(sums, ["file_id", "seq"], "left")
    size = F.col("f_stop") - F.col("f_start")
    state = F.when(F.col("covered").isNull(), "kept").when(F.col("covered") == size, "gone").when(F.col("covered") > 0, "cut").otherwise("kept")
    return both.select("file_id", "seq", F.coalesce("covered", F.lit(0)).alias("covered"), state.alias("state"))

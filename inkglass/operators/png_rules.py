"""Rules on the order and number of PNG chunks, as windows over chunk rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkglass.operators.png import COLOUR, SINGLE


def order_issues(chunks: DataFrame) -> DataFrame:
    """file_id, rule, seq, fatal for chunk rows (file_id, seq, type and, for two of the rules, length): a
    chunk that breaks a rule, or seq null for rules on the whole file."""
    by = W.partitionBy("file_id").orderBy("seq")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    some = lambda what: F.coalesce(F.bool_or(what).over(before), F.lit(False))
    kind = F.col("type")
    length = F.col("length") if "length" in chunks.columns else F.lit(None).cast("long")
    rows = chunks.select("file_id", "seq", "type", length.alias("length"), F.row_number().over(by).alias("rank"), some(kind == "IDAT").alias("after_idat"), some(kind == "PLTE").alias("after_plte"), F.row_number().over(W.partitionBy("file_id", "type").orderBy("seq")).alias("nth"))
    rows = rows.withColumn("apart", some(F.col("after_idat") & ~kind.isin("IDAT", "fdAT")))  # image data has been left
    rules = {
        "first-not-ihdr": ((F.col("rank") == 1) & (kind != "IHDR"), F.lit(True)),
        "ihdr-length": ((F.col("rank") == 1) & (kind == "IHDR") & (F.col("length") != 13), F.lit(True)),
        "repeated": (kind.isin(*SINGLE) & (F.col("nth") > 1), kind.isin("IHDR", "PLTE")),
        "idat-not-together": ((kind == "IDAT") & F.col("apart"), F.lit(True)),
        "plte-after-idat": ((kind == "PLTE") & F.col("after_idat"), F.lit(True)),
        "colour-late": (kind.isin(*COLOUR) & (F.col("after_idat") | F.col("after_plte")), F.lit(False)),
        "iend-data": ((kind == "IEND") & (F.col("length") != 0), F.lit(False)),
    }
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("rule"), fatal.alias("fatal"))) for k, (c, fatal) in rules.items()]))
    per_chunk = rows.select("file_id", "seq", F.explode(found).alias("x")).select("file_id", F.col("x.rule").alias("rule"), "seq", F.col("x.fatal").alias("fatal"))
    n = lambda t: F.count_if(kind == t)
    whole = chunks.groupBy("file_id").agg(n("IDAT").alias("idat"), n("IEND").alias("iend"), n("iCCP").alias("iccp"), n("sRGB").alias("srgb"))
    no_data = (F.col("idat") == 0) & (F.col("iend") > 0)
    both = F.array_compact(F.array(F.when(no_data, F.struct(F.lit("no-idat").alias("rule"), F.lit(True).alias("fatal"))), F.when((F.col("iccp") > 0) & (F.col("srgb") > 0), F.struct(F.lit("two-profiles").alias("rule"), F.lit(False).alias("fatal")))))
    per_file = whole.select("file_id", F.explode(both).alias("x")).select("file_id", F.col("x.rule").alias("rule"), F.lit(None).cast(chunks.schema["seq"].dataType).alias("seq"), F.col("x.fatal").alias("fatal"))
    return per_chunk.unionByName(per_file)


def verdicts(chunks: DataFrame) -> DataFrame:
    """file_id, issues, unsound (a fatal rule is broken) of every file."""
    found = order_issues(chunks).groupBy("file_id").agg(F.count(F.lit(1)).alias("issues"), F.bool_or("fatal").alias("unsound"))
    files = chunks.select("file_id").distinct()
    return files.join(found, "file_id", "left").select("file_id", F.coalesce("issues", F.lit(0)).cast("long").alias("issues"), F.coalesce("unsound", F.lit(False)).alias("unsound"))


def itemised(issues: DataFrame, most: int = 20) -> DataFrame:
    """The first `most` issues of a file, and one row with the number of the others."""
    rank = F.row_number().over(W.partitionBy("file_id").orderBy(F.col("seq").asc_nulls_last(), "rule"))
    rows = issues.withColumn("rank", rank)
    rest = rows.groupBy("file_id").agg(F.count_if(F.col("rank") > most).alias("more")).where("more > 0")
    return rows.where(F.col("rank") <= most).select("file_id", "rank", "rule", "seq", F.lit(None).cast("long").alias("more")).unionByName(rest.select("file_id", F.lit(most + 1).alias("rank"), F.lit("more").alias("rule"), F.lit(None).cast(issues.schema["seq"].dataType).alias("seq"), "more"))

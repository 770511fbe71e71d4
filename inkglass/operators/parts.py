"""Numbered binary parts: put together in order under a budget, and the CRC-32 of contents from those of their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkglass.functions.limits import ICC_BYTES
from inkglass.functions.text import bind

#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


def joined(parts: DataFrame, key: str, number: str, data: str, budget: int = ICC_BYTES) -> DataFrame:
    """key, n_parts, complete, content: the parts of each key in the order of their numbers, if these are 1 to n and all
    parts together have `budget` bytes at most; else the first part alone (of equal lowest numbers, the smallest bytes), complete being false.

    Numbers and sizes are summed first, without the parts. Only parts that will be in a result are then dealt by
    key, so no group holds more than the budget or one part. Cases: a null part counts as empty; a part with a null number
    makes its key incomplete and comes last; a number that occurs twice makes it incomplete."""
    rows = parts.select(F.col(key).alias("key"), F.col(number).cast("long").alias("number"), F.coalesce(F.col(data), F.lit(b"")).alias("data"))
    facts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_parts"), F.count("number").alias("numbered"), F.min("number").alias("low"), F.max("number").alias("high"), F.sum(F.octet_length("data")).alias("bytes"))
    # as many as the highest number says, none below 1; that none occurs twice is seen when they are together
    likely = (F.col("numbered") == F.col("n_parts")) & (F.col("low") == 1) & (F.col("high") == F.col("n_parts")) & (F.col("bytes") <= budget)
    told = facts.select("key", "n_parts", "low", F.coalesce(likely, F.lit(False)).alias("likely"))
    wanted = rows.alias("r").join(told.alias("t"), F.expr("r.key <=> t.key")).where("t.likely OR r.number <=> t.low").select("r.*", "n_parts", "likely")
    # the first part of those that aren't put together; partial minima keep one row a task
    alone = wanted.where("NOT likely").groupBy("key").agg(F.first("n_parts").alias("n_parts"), F.lit(False).alias("complete"), F.min("data").alias("content"))
    lists = wanted.where("likely").groupBy("key").agg(F.first("n_parts").alias("n_parts"), F.array_sort(F.collect_list(F.struct("number", "data"))).alias("parts"))
    whole = F.size(F.array_distinct(F.transform("parts", lambda x: x["number"]))) == F.col("n_parts")
    # hexadecimal, as Spark joins lists of strings only, and at once; adding one after the other would copy each many times
    all_parts = F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["data"])), ""))
    put = lists.select("key", "n_parts", whole.alias("complete"), F.when(whole, all_parts).otherwise(F.get("parts", 0)["data"]).alias("content"))
    return put.unionByName(alone).select(F.col("key").alias(key), "n_parts", "complete", "content")


def times(a: int, b: int) -> int:
    """The product of two polynomials over two elements, reversed, modulo the polynomial."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def powers() -> list[int]:
    """x to the 8 * 2^k for k from 0 to 62: what 2^k zero bytes do to a CRC."""
    p = 1 << 30  # x
    for _ in range(3):
        p = times(p, p)
    out = [p]
    while len(out) < 63:
        out.append(times(out[-1], out[-1]))
    return out


def product(a: Column, b: Column) -> Column:
    """times() of columns."""
    step = lambda x: F.shiftright(x, 1).bitwiseXOR(F.when(x.bitwiseAND(F.lit(1)) == 1, F.lit(POLYNOMIAL)).otherwise(F.lit(0)).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("out"), b.cast("long").alias("b"))

    def one(s: Column, bit: Column) -> Column:
        has = F.call_function("shiftright", a.cast("long"), bit)
        return F.struct(s["out"].bitwiseXOR(F.when(has.bitwiseAND(F.lit(1)) == 1, s["b"]).otherwise(F.lit(0).cast("long"))).alias("out"), step(s["b"]).alias("b"))

    return F.aggregate(F.sequence(F.lit(31), F.lit(0)), start, one, lambda s: s["out"])


def advanced(crc: Column, zeros: Column) -> Column:
    """The CRC after so many zero bytes, as far as it is linear: each binary digit of the number is one product."""
    table = F.array(*(F.lit(p).cast("long") for p in powers()))
    digits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.call_function("shiftright", zeros.cast("long"), k).bitwiseAND(F.lit(1)) == 1)
    return F.aggregate(digits, crc.cast("long"), lambda c, k: bind(lambda p: product(c, p), F.get(table, k)))


def crc_of_parts(parts: DataFrame, key: str, number: str, data: str) -> DataFrame:
    """key, n_bytes, crc32 of the parts of each key in the order of their numbers, which must differ.

    The CRC of parts in a row is the exclusive or of each part's, carried over the bytes after it, so parts are summed
    where they lie, and only their sizes and CRCs are dealt by key. Null parts count as empty."""
    part = F.coalesce(F.col(data), F.lit(b""))
    rows = parts.select(F.col(key).alias("key"), F.col(number).alias("number"), F.octet_length(part).cast("long").alias("n"), F.crc32(part).alias("crc"))
    after = W.partitionBy("key").orderBy("number").rowsBetween(1, W.unboundedFollowing)
    carried = rows.withColumn("crc", advanced(F.col("crc"), F.coalesce(F.sum("n").over(after), F.lit(0))))
    return carried.groupBy("key").agg(F.sum("n").alias("n_bytes"), F.bit_xor("crc").alias("crc32")).withColumnRenamed("key", key)

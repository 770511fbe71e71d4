"""Operator 11: exact duplicates by a 128-bit content hash, with the bytes compared inside groups.

Texts are equal when identical after every character of `[\\x20\\x09-\\x0D]` is deleted. Rows are
grouped by the MD5 of what is left; of a group the row with the most code points in its original
text stays, then the one with the smallest id. Only hashes, lengths and ids are shuffled for
that. The bytes are compared by the smallest and the largest text of each hash, which partial
aggregation brings down to one pair a task, also in a group with a third of all rows: if the two
differ, the hash collides, and its rows are grouped by hash and text instead.

Cases: a null text counts as empty; texts of white space only equal it. A row that repeats another
with its id counts in `group_size`, and only one of them is kept. A null id stands after all
others. An empty table gives none. Other columns, whatever their names, are left alone: `report`
doesn't return them, `dedup` does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkglass.llm.common import cut, join_groups

#: Fixed value: the white space that doesn't count.
BLANKS = r"[\x20\x09-\x0D]+"


def md5_128(data: Column) -> Column:
    return F.unhex(F.md5(data))


def verdict(rows: DataFrame, by: list[str]) -> DataFrame:
    """row, doc_id, text_sha256, keep_id, group_size, kept of rows (written before); those with equal `by` are a group."""
    order = F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("first")).filter("group_size > 1")
    found = join_groups(rows, cut(groups, "copies-groups"), by, "group_size")
    alone = F.col("group_size").isNull()
    return found.select(
        "row", "doc_id", "text_sha256", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"), (alone | (F.col("first.row") == F.col("row"))).alias("kept"),
    )


def collisions(rows: DataFrame) -> DataFrame:
    """The keys that texts of different bytes share."""
    return rows.groupBy("key").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).filter("low <> high").select("key")


def judge(texts: DataFrame, content_hash: Callable[[Column], Column]) -> DataFrame:
    """verdict() of texts: row, doc_id, text."""
    text = F.coalesce("text", F.lit(""))
    data = F.col("norm").cast("binary")
    told = texts.select("row", "doc_id", F.length(text).alias("n_points"), F.regexp_replace(text, BLANKS, "").alias("norm")).withColumns({"key": content_hash(data), "text_sha256": F.sha2(data, 256)})
    rows = cut(told.drop("norm"), "copies")
    clash = cut(collisions(told), "copies-collisions")
    if clash.isEmpty():
        return verdict(rows, ["key"])
    apart = cut(told.join(clash, "key", "left_semi"), "copies-apart")
    plain = cut(rows.join(clash, "key", "left_anti"), "copies-plain")
    return verdict(plain, ["key"]).unionByName(verdict(apart, ["key", "norm"]))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """A row for each row: doc_id, keep_id (of the row that stays), group_size, kept, text_sha256."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    return judge(texts, content_hash).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    whole = cut(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.monotonically_increasing_id().alias("row")), "copies-documents")
    texts = whole.select(F.col(f"d.`{id_col}`").alias("doc_id"), F.col(f"d.`{text_col}`").alias("text"), "row")
    return whole.join(judge(texts, content_hash).filter("kept").select("row"), "row", "left_semi").select("d.*")

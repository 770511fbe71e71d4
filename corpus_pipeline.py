"""A training corpus in five stages; each works on all documents that the one before has kept.

Cases, the same in every stage: a table without rows gives one without rows. A null text counts as empty; the
quality rules reject it, and a stage that is called by itself keeps it as it is. A null id is a document
like another; in ties it comes first or last, as the stage's operator says. Repeated rows are judged alike: they go or stay
together, but for near duplicates, where the smallest id stays and rows that share it stay together. Extra columns come
out as they went in, whatever their names; the last stage returns its own columns only.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from inkglass.llm import decontaminate, jaccard_regions, line_edits, line_rules, pair_index_bpe
from inkglass.llm.common import drop_folder, new_folder, scratch, table
from inkglass.llm.queries import TOKENIZERS
from inkglass.shipping import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rules reject, and lines above the limit from others; n_chars follows the text. A null host is one of its own."""
    return line_rules.apply_rules(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that occur before: equal ones, and those within an edit for each ten characters, two at most. Documents stay, if with no line; n_chars follows the text."""
    return line_edits.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of linked documents. Documents without words are linked with none."""
    ship_package(spark)
    return jaccard_regions.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window of the benchmark; items without words have none."""
    ship_package(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, ids and decoded texts (as hashes) of what is left."""
    ship_package(spark)
    return pair_index_bpe.round_trip(docs, os.path.join(TOKENIZERS, "byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination), ("BPE encoding and decoding", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents table. What the operators have written on the way is deleted stage by stage."""
    docs, before, folder = table(spark, sf_dir, "documents"), None, new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


#: The stages' hashes and edit joins are beyond SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None

"""Operator 13: product codes of vectors, whose codebooks come from treeAggregate over columnar blocks.

Components become integers, floor(scale * x), and vectors are cut into equal consecutive parts. A
part position's codebook starts as that part of the vectors with the smallest ids. A round holds
every part against its codebook and replaces each entry by the floored mean of its parts. The work
is an RDD treeAggregate over blocks of integers, a row a dimension: distances of a block are added
up dimension by dimension, np.add.at puts parts into sum and count tensors of fixed size, and those
merge through a tree of reducers. Nothing but these tensors reaches the driver.

Cases: vectors that are null, empty or hold null or non-finite components are dropped, and so are
those of another length than most have (the larger of two equally frequent ones); that length must
be a multiple of the number of parts, or a ValueError says so. Ties in distance go to the lower
index; equal ids are taken in the order of their vectors, null ids last. With fewer vectors than
entries a codebook has as many entries as there are vectors. An empty table gives no rows. Integers
that could leave 64 bits anywhere are computed with Python's own; an error beyond a long is null,
and so is the label's sum. Other columns are ignored. Repeated rows give equal rows.
"""

from __future__ import annotations

import functools
import hashlib
import math
import pickle

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkglass.llm.common import cut, join_groups, small_batches

#: Bytes of a block's integers.
BLOCK_BYTES = 4 << 20
MOST_LONG = (1 << 63) - 1


def whole_numbers(vectors: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """floor(scale * x) of doubles: as int64, or exactly as Python's integers."""
    if not wide:
        return np.floor(vectors * scale).astype(np.int64)
    exact = lambda x: int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale)
    return np.array([[exact(x) for x in v] for v in vectors.tolist()], object).reshape(vectors.shape)


def distances(columns: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances (entry, vector) of a part, added up dimension by dimension; columns has a row a dimension."""
    total = np.zeros((len(book), columns.shape[1]), columns.dtype)
    for d, column in enumerate(columns):
        apart = column[None, :] - book[:, d, None]
        total += apart * apart
    return total


def gathered(books: np.ndarray, sums_counts: tuple[np.ndarray, np.ndarray], block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """sums and counts with those of a block; books is (part, entry, dimension)."""
    sums, counts = sums_counts
    columns = pickle.loads(block)
    width = books.shape[2]
    for p, book in enumerate(books):
        part = columns[p * width : (p + 1) * width]
        nearest = distances(part, book).argmin(0)
        np.add.at(sums[p], nearest, part.T)
        np.add.at(counts[p], nearest, 1)
    return sums, counts


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return a[0] + b[0], a[1] + b[1]


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, int, float]:
    """The vectors of the usual length (vec_id, label, v: doubles), that length, and the largest magnitude."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), v.alias("v")).filter(F.coalesce(finite, F.lit(False)) & (F.size(v) > 0))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("k"), F.max(F.array_max(F.transform("v", F.abs))).alias("top"))
    usual = lengths.orderBy(F.desc("k"), F.desc("n")).first()
    return (rows, 0, 0.0) if usual is None else (rows.filter(F.size("v") == usual.n), usual.n, usual.top)


def to_blocks(rows: DataFrame, size: int, scale: int, wide: bool) -> DataFrame:
    """Rows of ids, labels and their vectors' integers, a row a dimension."""
    import pyarrow as pa

    most = max(1, BLOCK_BYTES // (8 * size))
    id_type, label_type = rows.schema["vec_id"].dataType, rows.schema["label"].dataType

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                flat = part.column(2).flatten().to_numpy(zero_copy_only=False)
                numbers = np.ascontiguousarray(whole_numbers(flat.reshape(part.num_rows, size), scale, wide).T)
                offsets = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, part.column(0)), pa.ListArray.from_arrays(offsets, part.column(1)), pa.array([pickle.dumps(numbers)], pa.binary())], names=["ids", "labels", "block"])

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, T.StructType().add("ids", T.ArrayType(id_type)).add("labels", T.ArrayType(label_type)).add("block", T.BinaryType()))


def train(blocks: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """books after so many rounds over the blocks (written before)."""
    data = blocks.select("block").rdd.map(lambda r: r[0])
    for _ in range(rounds):
        # each task starts from zeros of its own: the tensors are changed in place
        zero = (np.zeros(books.shape, books.dtype), np.zeros(books.shape[:2], np.int64))
        sums, counts = data.treeAggregate(zero, functools.partial(gathered, books), merged)
        filled = counts > 0
        books = np.where(filled[:, :, None], sums // np.where(filled, counts, 1)[:, :, None], books)
    return books


def assigned(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of every vector."""
    import pyarrow as pa

    width, digits = books.shape[2], 2
    schema = T.StructType().add("vec_id", blocks.schema["ids"].dataType.elementType).add("label", blocks.schema["labels"].dataType.elementType).add("code", T.StringType()).add("error", T.LongType())

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                columns = pickle.loads(batch.column(2)[i].as_py())
                found, error = [], 0
                for p, book in enumerate(books):
                    far = distances(columns[p * width : (p + 1) * width], book)
                    found.append(far.argmin(0))
                    error = error + far.min(0)
                codes = ["".join(f"{k:0{digits}x}" for k in row) for row in np.stack(found, 1).tolist()]
                errors = pa.array([e if e <= MOST_LONG else None for e in error.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, pa.array(codes, pa.string()), errors], names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, schema)


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable vector; two hex digits an index, so 256 entries at most."""
    spark = vectors.sparkSession
    rows, size, top = usable(vectors, id_col, vector_col, label_col)
    if not size:
        return empty(spark, rows)
    if size % parts:
        raise ValueError(f"vectors of {size} components have no {parts} equal parts")
    total = rows.count()
    most = scale * int(top) + scale
    wide = size * (2 * most) ** 2 > MOST_LONG or total * most > MOST_LONG
    blocks = cut(to_blocks(rows, size, scale, wide), "codes-blocks")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    numbers = whole_numbers(np.array([r.v for r in first], float), scale, wide)
    books = train(blocks, np.stack(np.split(numbers, parts, 1)), rounds)
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = cut(assigned(blocks, books), "codes")
    sums = coded.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(38,0)"))).alias("s"))
    labels = cut(sums.select("label", "n", F.when(F.col("s") <= MOST_LONG, F.col("s")).cast("long").alias("label_error")), "codes-labels")
    return join_groups(coded, labels, ["label"], "n").select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def empty(spark: SparkSession, rows: DataFrame) -> DataFrame:
    schema = T.StructType([rows.schema["vec_id"]]).add("code", "string").add("error", "long").add("label_error", "long").add("codebooks_sha256", "string")
    return spark.createDataFrame([], schema)

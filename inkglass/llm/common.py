"""What the operators of this subpackage share: cut points, shared files, tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Folders of this machine that stand in for the shared one of a local session, by application.
_local: dict[str, str] = {}
#: What scratch() is to delete.
_watched: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where that is unset (tests, local sessions) it is a folder of this machine, which
    only a local master can use. The session is left as it is.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="spark-inkglass-")
        found = _local[app]
    return found.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A path of this run's own in the shared folder (not yet made)."""
    path = f"{shared_dir(spark)}/inkglass/{what}-{uuid.uuid4().hex}"
    for made in _watched:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Tables and files that operators put into the shared folder inside are deleted at the end, so what is to stay
    must have been written elsewhere or read by then."""
    made: list[str] = []
    _watched.append(made)
    try:
        yield
    finally:
        _watched.remove(made)
        for path in made:
            drop_folder(spark, path)


def cut(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it again, which ends its lineage there."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows that are broadcast at most; more are joined by shuffle.
BROADCAST_BYTES = 8 << 20


def row_bytes(schema: T.StructType) -> Column:
    """About what a row takes in a broadcast table."""
    total = F.lit(64)
    for f in schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 16
        elif isinstance(f.dataType, T.ArrayType):
            total = total + F.greatest(F.size(F.col(f"`{f.name}`")), F.lit(0)) * 40 + 24
        else:
            total = total + (16 if isinstance(f.dataType, T.StructType) else 8)
    return total.cast("long")


def fits(rows: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """If rows (written before) are counted to take at most so many bytes."""
    return (rows.agg(F.sum(row_bytes(rows.schema))).first()[0] or 0) <= most


def light(rows: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """rows (written before), to be broadcast if they fit, else joined by shuffle. The result is the same."""
    return F.broadcast(rows) if fits(rows, most) else rows


#: A group with this share of all rows is one of at most so many: its row is broadcast.
HEAVY = 1000


def join_groups(rows: DataFrame, groups: DataFrame, by: list[str], size: str) -> DataFrame:
    """rows with the columns of their group, null where they have none. Both were written before; groups has a
    row for each value of `by`, whose column `size` counts its rows. The rows of groups with a thousandth of all
    or more, of which there are a thousand at most, are joined by broadcast where they lie; only the others are
    dealt by their key. Null keys match."""
    total = rows.count()
    matches = lambda g: [F.col(f"r.{c}").eqNullSafe(F.col(f"{g}.{c}")) for c in by]
    more = [c for c in groups.columns if c not in by]
    heavy = F.broadcast(groups.filter(F.col(size) * HEAVY >= total)).alias("h")
    left = rows.alias("r")
    found = left.join(heavy, matches("h")).select("r.*", *(f"h.{c}" for c in more))
    others = left.join(heavy, matches("h"), "left_anti").alias("r")
    light_ones = groups.filter(F.col(size) * HEAVY < total).alias("g")
    return found.unionByName(others.join(light_ones, matches("g"), "left").select("r.*", *(f"g.{c}" for c in more)))


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def file_system(uri: str):
    """(pyarrow file system, path in it) of a URI of the shared folder, on any machine."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class SharedFile:
    """Writes one file of the shared folder under a name of the attempt's own and moves it
    to its place at the end, so a repeated or lost task leaves a whole file or none."""

    def __init__(self, uri: str):
        self.fs, self.path = file_system(uri)
        self.own = f"{self.path}.{uuid.uuid4().hex}.part"

    def __enter__(self):
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.own)
        return self

    def write(self, data: bytes) -> int:
        self.out.write(data)
        return len(data)

    def __exit__(self, kind, value, trace):
        self.out.close()
        if kind is None:
            self.fs.move(self.own, self.path)
        else:
            self.fs.delete_file(self.own)
        return False


def bind(f, value: Column) -> Column:
    """f(value) with value worked out once. An expression that a lambda names stands in it whole and
    is worked out for every element; as a lambda's variable it isn't."""
    return F.get(F.transform(F.array(value), f), 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that goes to a Python worker.
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends texts to Python in batches of BATCH_BYTES at most: a batch is
    in memory several times over, in the JVM and in the worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, f"{BATCH_BYTES}b")


def text_slices(batch, column: int, most: int):
    """(from, texts) of runs of about so many bytes, one text at least."""
    texts, at = batch.column(column), 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size < most):
            size += len(texts[stop].as_buffer() or b"")
            stop += 1
        yield at, texts.slice(at, stop - at).to_pylist()
        at = stop


def text_bytes(column: str = "text"):
    """The UTF-8 bytes of a string column; null gives none."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))

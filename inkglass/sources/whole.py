"""Large collections of files, listed and read in tasks.

Spark's binary source keeps every file's entry in the driver and takes about 0.5 ms of the JVM's CPU for each small file. Here the folders
of a level are listed by a job, whose rows (a file each) are written to the folder that driver and executors share; the driver
holds the folders only. The files are then dealt evenly and each is opened once.

Paths are URIs of any file system that Arrow knows, hidden names (`_`, `.`) are left out as by Spark's sources.

Cases: an empty or missing folder gives no rows. Empty files and those above a length are left out before they are opened. Of a
file that has grown since it was listed, one byte more than its length is read, so its change shows. One that was taken away ends the job.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkglass.shared import new_folder
from inkglass.sources.ranges import opened

#: Folders that a task lists, files and bytes that one reads, and bytes that it hands on at once.
FOLDERS_EACH, FILES_EACH, BYTES_EACH, BATCH_BYTES = 16, 2000, 128 << 20, 4 << 20
LISTED = "inner string, folder boolean, length long, modificationTime timestamp"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """inner (what follows the path given), length and modificationTime of all files below a path."""
    import pyarrow as pa

    def run(batches):
        from pyarrow import fs

        system, root = opened(path)
        root = root.rstrip("/")
        for batch in batches:
            for at in batch.column(0).to_pylist():
                found = [f for f in system.get_file_info(fs.FileSelector(root + at, allow_not_found=True)) if not f.base_name.startswith(("_", ".")) and f.type in (fs.FileType.File, fs.FileType.Directory)]
                yield pa.RecordBatch.from_pydict({
                    "inner": pa.array([f"{at}/{f.base_name}" for f in found], pa.string()), "folder": pa.array([f.type == fs.FileType.Directory for f in found], pa.bool_()),
                    "length": pa.array([f.size for f in found], pa.int64()), "modificationTime": pa.array([f.mtime_ns // 1000 if f.mtime_ns else 0 for f in found], pa.timestamp("us", "UTC")),
                })

    folder = new_folder(spark, "listing")
    level = [""]
    while level:
        rows = spark.createDataFrame([(x,) for x in level], "inner string").repartition(-(-len(level) // FOLDERS_EACH))
        at = f"{folder}/level={len(level[0].split('/')):05d}"
        rows.mapInArrow(run, LISTED).write.parquet(at)
        level = [r.inner for r in spark.read.schema(LISTED).parquet(at).where("folder").select("inner").collect()]
    return spark.read.schema(LISTED).option("recursiveFileLookup", "true").parquet(folder).where("NOT folder").drop("folder")


def whole_files(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """path, modificationTime, length, content of all files below a path that are not empty (nor longer than most)."""
    import pyarrow as pa

    listed = list_files(spark, path).where("length > 0")
    if most is not None:
        listed = listed.where(F.col("length") <= most)
    n_files, n_bytes = listed.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    n = max(4 * spark.sparkContext.defaultParallelism, -(-n_files // FILES_EACH), -(-n_bytes // BYTES_EACH))

    def run(batches):
        system, root = opened(path)
        root = root.rstrip("/")
        for batch in batches:
            begin, held, contents = 0, 0, []
            for k, (inner, length) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                with system.open_input_file(root + inner) as f:
                    contents.append(f.read(length + 1))
                held += len(contents[-1])
                if held >= BATCH_BYTES:
                    yield rows(batch, begin, contents)
                    begin, held, contents = k + 1, 0, []
            if contents:
                yield rows(batch, begin, contents)

    def rows(batch, begin: int, contents: list[bytes]):
        part = batch.slice(begin, len(contents))
        return pa.RecordBatch.from_arrays([part.column(3), part.column(2).cast(pa.timestamp("us", "UTC")), part.column(1), pa.array(contents, pa.binary())], names=["path", "modificationTime", "length", "content"])

    named = listed.select("inner", "length", "modificationTime", F.concat(F.lit(os.fspath(path).rstrip("/")), "inner").alias("path"))
    # rows of files are dealt, not their contents
    return named.repartition(n, F.xxhash64("inner")).mapInArrow(run, "path string, modificationTime timestamp, length long, content binary")

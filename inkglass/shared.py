"""Tables and files of a run in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, what: str) -> str:
    """A path of a run's own (not yet made) below spark.checkpoint.dir of the session; where that is unset, in a folder of
    this machine, which only a local master can use. The session is left as it is."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-inkglass-")
    return f"{found.rstrip('/')}/inkglass/{what}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bytes of a batch that a Python worker gets: files are large, and a batch of 10,000 rows would hold too many of them. The
    session's setting must hold when the result is computed, so it isn't set back; a smaller one is left."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if now <= 0 or now > most:
        spark.conf.set(key, str(most))

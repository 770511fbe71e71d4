"""Job control as keyed state: at most one active job a key, superseded by the next one, ended by its
deadline, and guarded against messages of earlier jobs.

Messages (key, at, message_id, kind, generation) arrive as a stream. `start` begins a job: the key's
next generation, which supersedes an active one. `progress`, `result`, `error` and `cancel` belong to
the generation that they name (null: the current one); of another generation, or with no active job,
they are stale and change nothing. A job ends at its deadline unless it ended before: a timer on
event time, or the key's next message beyond the deadline, whichever comes first; either gives the
same row, at the deadline.

Rows out: key, at, generation, outcome (started, progress, result, error, cancelled, superseded,
timeout, stale) and the id of the message, or of the job's start where the job is ended by other
than its own message (superseded, timeout).

State is one small row a key. In a batch a key's messages are put in order of (at, message_id); of
them only these five columns are held in a task, and `maxFilesPerTrigger` bounds the batch.

Cases: messages of unknown kinds are stale. Rows with a null key, time or id are left out. Equal
messages count each: the second result of a job is stale. A message that is later than the
watermark is dropped by the engine. An empty stream gives no rows. Active jobs at the end stay in state.
"""

from __future__ import annotations

import sys
from contextlib import contextmanager
from operator import itemgetter

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from inkglass.functions import limits

ROWS = StructType().add("key", "string").add("at", "timestamp").add("generation", "long").add("outcome", "string").add("message_id", "long")
JOB = StructType().add("generation", "long").add("active", "boolean").add("started_id", "long").add("deadline_ms", "long")
#: Kinds that end the active job, and what they make of it.
ENDS = {"result": "result", "error": "error", "cancel": "cancelled"}


class JobControl(StatefulProcessor):
    def __init__(self, seconds: float):
        self.milliseconds = int(seconds * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", JOB)

    def close(self) -> None:
        pass

    def now(self) -> tuple[int, bool, int, int]:
        found = self.job.get()  # one call; None where there is none
        return (0, False, 0, 0) if found is None else tuple(found)

    def put(self, state: tuple[int, bool, int, int], before: tuple[int, bool, int, int]) -> None:
        """Keeps the state; its timer is the active job's deadline."""
        if before[1] and (not state[1] or state[3] != before[3]):
            self.handle.deleteTimer(before[3])
        if state[1] and (not before[1] or state[3] != before[3]):
            self.handle.registerTimer(state[3])
        self.job.update(state)

    def handleInputRows(self, key, rows, timerValues):
        # a key has few messages, for which a frame's own sorting takes longer than all else
        messages = [m for part in rows for m in zip(*(part[c].tolist() for c in ("at_ms", "message_id", "kind", "generation")), strict=True)]
        messages.sort(key=itemgetter(0, 1))
        before = state = self.now()
        out = []
        for at, message_id, kind, named in messages:
            state = self.fold(state, at, message_id, kind, None if named is None or named != named else int(named), out)
        self.put(state, before)
        yield framed(key[0], out)

    def fold(self, state, at: int, message_id: int, kind: str, named: int | None, out: list) -> tuple[int, bool, int, int]:
        """The state after a message; what happens goes to out."""
        generation, active, started, deadline = state
        if active and at >= deadline:
            out.append((deadline, generation, "timeout", started))
            active = False
        if kind == "start":
            if active:
                out.append((at, generation, "superseded", started))
            out.append((at, generation + 1, "started", message_id))
            return generation + 1, True, message_id, at + self.milliseconds
        if not active or named not in (None, generation) or kind not in (*ENDS, "progress"):
            out.append((at, generation if named is None else named, "stale", message_id))
        else:
            out.append((at, generation, ENDS.get(kind, kind), message_id))
            active = kind == "progress"
        return generation, active, started, deadline

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        generation, active, started, deadline = self.now()
        if active and deadline == expiredTimerInfo.getExpiryTimeInMs():
            self.job.update((generation, False, started, deadline))
            yield framed(key[0], [(deadline, generation, "timeout", started)])


def framed(key: str, rows: list[tuple[int, int, str, int]]):
    import numpy as np
    import pandas as pd

    at, generation, outcome, message_id = zip(*rows, strict=True) if rows else ((), (), (), ())
    n = lambda values, kind: np.array(values, dtype=kind)
    return pd.DataFrame({"key": n([key] * len(rows), "object"), "at": n(at, "int64").astype("datetime64[ms]").astype("datetime64[ns]"), "generation": n(generation, "int64"), "outcome": n(outcome, "object"), "message_id": n(message_id, "int64")})


def controlled(messages: DataFrame, seconds: float = limits.SECONDS, delay: str = "0 seconds") -> DataFrame:
    """What becomes of a stream of messages: key, at, message_id, kind, generation. The state store must be RocksDB."""
    rows = messages.select(F.col("key").cast("string").alias("key"), F.date_trunc("millisecond", F.col("at").cast("timestamp")).alias("at"), F.unix_millis(F.col("at").cast("timestamp")).alias("at_ms"), F.col("message_id").cast("long").alias("message_id"), "kind", F.col("generation").cast("long").alias("generation"))
    # the worker that a stream starts beside the driver isn't sent the package, so the processor goes to it whole
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = rows.where("key IS NOT NULL AND at IS NOT NULL AND message_id IS NOT NULL").withWatermark("at", delay)
    return rows.groupBy("key").transformWithStateInPandas(JobControl(seconds), ROWS, "Append", "EventTime")


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries that are started inside have their state in RocksDB; the session's setting is as before after."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def run_available(spark: SparkSession, messages_path: str, sink: str, checkpoint: str, schema: StructType, seconds: float = limits.SECONDS, files_each: int | None = None, delay: str = "0 seconds") -> None:
    """Takes all messages (Parquet) that are there, writes what becomes of them as Parquet, and ends."""
    reader = spark.readStream.schema(schema)
    if files_each:
        reader = reader.option("maxFilesPerTrigger", files_each)
    with rocksdb(spark):
        query = controlled(reader.parquet(messages_path), seconds, delay).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(sink)
        query.awaitTermination()

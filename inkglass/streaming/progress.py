"""Progress of streaming inspections, as Spark's own listener events."""

from __future__ import annotations

from threading import Lock

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """The stage of each query by its run id: reading once it has started, inspecting while batches
    end (with the files so far), then done or failed. Add it with spark.streams.addListener."""

    def __init__(self):
        self.lock, self.now = Lock(), {}

    def note(self, run, stage: str, files: int = 0) -> None:
        with self.lock:
            self.now[str(run)] = (stage, self.now.get(str(run), ("", 0))[1] + files)

    def onQueryStarted(self, event) -> None:
        self.note(event.runId, "reading")

    def onQueryProgress(self, event) -> None:
        self.note(event.progress.runId, "inspecting", event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.note(event.runId, "failed" if event.exception else "done")


class BatchProgress:
    """Measures the stages of one job while it runs: rows pass stage() on their way, and figures() tells what has passed
    once the job's action is over. Nothing is read or worked out a second time.

    A stage's figures are aggregates over its rows. Rows that a later stage's limit never asks for aren't counted. An empty
    stage counts zero, and its sums are null."""

    def __init__(self):
        self.observed: dict[str, Observation] = {}

    def stage(self, name: str, rows: DataFrame, **figures: Column) -> DataFrame:
        """rows as they are."""
        if name in self.observed:
            raise ValueError(f"stage {name} is measured already")
        self.observed[name] = Observation()
        return rows.observe(self.observed[name], *(c.alias(k) for k, c in figures.items()))

    def figures(self) -> list[tuple[str, str, int | None]]:
        """(stage, figure, value) in the order of the stages; waits for the action."""
        return [(name, k, v) for name, o in self.observed.items() for k, v in o.get.items()]

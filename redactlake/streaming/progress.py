"""Progress of a job, counted as its rows pass: no action is added, and nothing is read twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def _counts(done: Column) -> list[Column]:
    return [F.count_if(F.coalesce(done, F.lit(False))).alias("done"), F.count(F.lit(1)).alias("total")]


def observed(rows: DataFrame, done: Column) -> tuple[DataFrame, Observation]:
    """rows, and what tells, once an action on them has ended, {done, total} of its rows (observation.get)."""
    watch = Observation()
    return rows.observe(watch, *_counts(done)), watch


def watched(rows: DataFrame, name: str, done: Column) -> DataFrame:
    """A stream's rows, counted under a name in each micro-batch; see Progress."""
    return rows.observe(name, *_counts(done))


class Progress(StreamingQueryListener):
    """Calls back with (name, batch, done, total) after each micro-batch of watched() rows."""

    def __init__(self, tell: Callable[[str, int, int, int], None]) -> None:
        self.tell = tell

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        for name, row in event.progress.observedMetrics.items():
            self.tell(name, event.progress.batchId, row["done"], row["total"])

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

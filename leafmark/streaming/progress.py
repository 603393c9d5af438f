"""Progress of a run, measured while it is written: observed metrics and a listener that hands them on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

NAME = "pages_done"


def measures(error: str = "error", reused: str = "reused") -> list[Column]:
    """Pages, errors and reused pages of the rows that go by."""
    return [F.count(F.lit(1)).alias("pages"), F.count_if(F.col(error).isNotNull()).alias("errors"), F.count_if(F.coalesce(F.col(reused), F.lit(False))).alias("reused")]


def watched(pages: DataFrame, columns: list[Column] | None = None) -> tuple[DataFrame, Observation]:
    """The pages, and what is known of them once an action has run over them: no second pass."""
    seen = Observation(NAME)
    return pages.observe(seen, *(columns or measures())), seen


def watched_stream(pages: DataFrame, columns: list[Column] | None = None) -> DataFrame:
    """The same for a stream: each micro-batch reports its own counts, to a `Progress` listener."""
    return pages.observe(NAME, *(columns or measures()))


class Progress(StreamingQueryListener):
    """Calls back with batch number and counts at the end of each micro-batch, and keeps the sums of each query."""

    def __init__(self, told: Callable[[int, dict], None] | None = None):
        self.told, self.sums = told, {}

    def onQueryStarted(self, event) -> None:
        self.sums.setdefault(str(event.id), {})

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(NAME)
        if row is not None and event.progress.numInputRows > 0:
            counts = row.asDict()
            total = self.sums.setdefault(str(event.progress.id), {})
            for k, v in counts.items():
                total[k] = total.get(k, 0) + v
            if self.told:
                self.told(event.progress.batchId, counts)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

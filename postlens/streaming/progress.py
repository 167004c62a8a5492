"""Progress of streaming queries and of stages, for whoever asks to be told."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Calls ``tell`` with (name of the query or its id, rows of the batch) after every batch, and with (…, -1) when a query ends."""

    def __init__(self, tell: Callable[[str, int], None]) -> None:
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell(event.name or str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        self.tell(event.progress.name or str(event.progress.id), event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.tell(str(event.id), -1)


def observed(rows: DataFrame, stage: str) -> tuple[DataFrame, Observation]:
    """``rows`` as they are, and an observation of how many go by, without another job."""
    seen = Observation(stage)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows")), seen

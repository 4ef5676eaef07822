"""What a running or finished query reports about itself."""

from __future__ import annotations

import logging
import time
from collections import Counter

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from sluiceway.plans.ingest import IngestResult

log = logging.getLogger(__name__)


class Tally:
    """Adds up the results of an ingest; pass it as ``on_result``.

    Logs the count of valid messages whenever it passes a multiple of ``every``.
    """

    def __init__(self, every: int = 1000) -> None:
        self.every = every
        self.windows = 0
        self.valid = 0
        self.null_keys = 0
        self.rejected: Counter[str] = Counter()

    def __call__(self, result: IngestResult) -> None:
        before = self.valid // self.every
        self.windows += 1
        self.valid += result.valid
        self.null_keys += result.null_keys
        self.rejected.update(result.rejected)
        if self.valid // self.every > before:
            log.info("%d valid messages up to now", self.valid)


class ProgressTotals(StreamingQueryListener):
    """Adds up every progress event of the session's queries, each micro-batch once.

    The progress that a query keeps is cut to its last entries; what a listener has added
    up is not. Use as a context: it listens from entering to leaving.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.rows: Counter[str] = Counter()
        self.late: Counter[str] = Counter()
        self.ended: set[str] = set()
        self._last: dict[str, int] = {}

    def __enter__(self) -> ProgressTotals:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error: object) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        self._last.setdefault(str(event.runId), -1)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        run = str(progress.runId)
        if progress.batchId <= self._last.get(run, -1) and not progress.numInputRows:
            late = 0  # an idle report of a batch that is counted already
        else:
            late = sum(o.numRowsDroppedByWatermark for o in progress.stateOperators)
        self._last[run] = max(progress.batchId, self._last.get(run, -1))
        self.rows[str(progress.id)] += progress.numInputRows
        self.late[str(progress.id)] += late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def wait(self, query: StreamingQuery, seconds: float = 30) -> ProgressTotals:
        """Wait until all events of a query that has ended were delivered."""
        until = time.monotonic() + seconds
        while str(query.runId) not in self.ended and time.monotonic() < until:
            time.sleep(0.05)
        return self

    def late_rows(self, query: StreamingQuery) -> int:
        """Rows that came after their event-time window had closed."""
        return self.late[str(query.id)]

    def total_rows(self, query: StreamingQuery) -> int:
        return self.rows[str(query.id)]


def progress_rows(query: StreamingQuery) -> list[dict]:
    """Rows read per micro-batch that the query still reports; totals: ProgressTotals."""
    return [
        {
            "batch_id": progress.batchId,
            "rows": progress.numInputRows,
            "rows_per_second": progress.processedRowsPerSecond,
        }
        for progress in query.recentProgress
    ]

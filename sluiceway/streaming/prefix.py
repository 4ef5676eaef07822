"""A stream that takes the first n valid messages and then ends itself."""

from __future__ import annotations

import threading
from collections.abc import Callable
from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluiceway.operators.decode import accepted
from sluiceway.operators.windows import DEFAULT_DURATION
from sluiceway.sinks.tables import batch_path
from sluiceway.streaming.windows import for_each_window, keep_total, total_before

POLL = 0.2  # seconds between two looks at whether the query still runs


def taken(spark: SparkSession, path: str) -> int:
    """How many valid messages the micro-batches up to now have given."""
    try:
        totals = spark.read.schema("total BIGINT").parquet(f"{path}/totals")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return totals.agg(F.max("total")).first()[0] or 0


def take_batch(
    df: DataFrame,
    batch_id: int,
    path: str,
    n: int,
    order_by: list[str],
    parse: Callable[[DataFrame], DataFrame],
) -> int:
    """Write what a micro-batch adds to the first ``n``; the new total. A repeat overwrites."""
    spark = df.sparkSession
    before = total_before(spark, f"{path}/totals", batch_id)
    total = before
    if before < n:
        rows = accepted(parse(df)).orderBy(*order_by).limit(n - before)
        target = batch_path(f"{path}/rows", batch_id)
        rows.write.mode("overwrite").parquet(target)
        total += spark.read.schema(rows.schema).parquet(target).count()
    keep_total(spark, f"{path}/totals", batch_id, total)
    return total


def follow_first_n(
    stream: DataFrame,
    path: str,
    n: int,
    order_by: list[str],
    checkpoint: str,
    parse: Callable[[DataFrame], DataFrame],
    every: timedelta = DEFAULT_DURATION,
    available_now: bool = False,
) -> StreamingQuery | None:
    """Write the first ``n`` valid messages to ``path/rows`` and stop; None if they are there.

    Micro-batches follow each other in the order of the source, ``order_by`` orders the
    rows inside one. The total of each is stored beside its rows, so a restart goes on where
    the last run stopped, and a micro-batch that is run again gives the same rows.
    """
    if taken(stream.sparkSession, path) >= n:
        return None
    reached = threading.Event()

    def handle(df: DataFrame, batch_id: int) -> None:
        if take_batch(df, batch_id, path, n, order_by, parse) >= n:
            reached.set()

    query = for_each_window(stream, handle, checkpoint, every, available_now)
    threading.Thread(target=_stop_when, args=(query, reached), daemon=True).start()
    return query


def _stop_when(query: StreamingQuery, reached: threading.Event) -> None:
    # A micro-batch cannot stop its own query: stopping waits for it to end.
    while query.isActive and not reached.wait(POLL):
        pass
    if reached.is_set():
        query.stop()

"""Continuous ingest: every arrival window is decoded, typed, split and written."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sluiceway.operators.windows import DEFAULT_DURATION
from sluiceway.plans.ingest import IngestResult, ingest_batch
from sluiceway.schema import message_schema
from sluiceway.streaming.windows import for_each_window, keep_total, total_before


def start_ingest(
    messages: DataFrame,
    schema: T.StructType | str,
    key: str,
    path: str | None = None,
    checkpoint: str = "",
    every: timedelta = DEFAULT_DURATION,
    available_now: bool = False,
    on_result: Callable[[IngestResult], None] | None = None,
    totals: str | None = None,
    **options,
) -> StreamingQuery:
    """Run :func:`ingest_batch` on every micro-batch of a stream; ``options`` are passed to it.

    A batch that cannot be written fails the query, and is read again on restart. Arrival
    windows need an origin, or every micro-batch would count from 1. Count windows go on
    over micro-batches; the directory ``totals`` keeps how many messages came before.
    """
    schema = message_schema(schema)
    if not checkpoint:
        raise ValueError("a stream needs a checkpoint")
    window = options.get("window")
    if window is not None and window.origin is None:
        raise ValueError("arrival windows of a stream need an origin")
    if options.get("count_size") is not None and totals is None:
        raise ValueError("count windows of a stream need a directory for totals")

    def handle(rows: DataFrame, batch_id: int) -> None:
        start = {} if totals is None else {"start": total_before(rows.sparkSession, totals, batch_id)}
        result = ingest_batch(rows, schema, key, path, batch_id, **start, **options)
        if totals is not None:
            keep_total(rows.sparkSession, totals, batch_id, start["start"] + result.valid)
        if on_result is not None:
            on_result(result)

    return for_each_window(messages, handle, checkpoint, every, available_now)

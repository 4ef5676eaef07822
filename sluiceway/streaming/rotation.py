"""Windows of a stream that close in turn, empty ones included, and the one that is open."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from sluiceway.operators.windows import DEFAULT_DURATION, WindowSpec, _described, _numbered
from sluiceway.sinks.tables import batch_path
from sluiceway.streaming.state import timed_state
from sluiceway.streaming.windows import for_each_window

SHARDS = 16
ROWS_AT_ONCE = 100_000
CLOSED = "window_no BIGINT, rows BIGINT"
EPOCH = datetime(1970, 1, 1)


def micros(moment: datetime) -> int:
    """Microseconds since the epoch; a time without a zone is in UTC."""
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    return (moment - EPOCH) // timedelta(microseconds=1)


def fixed_origin(spec: WindowSpec) -> datetime:
    if not isinstance(spec.origin, datetime):
        raise ValueError("arrival windows of a stream need a time as origin")
    return spec.origin


class _Rotation(StatefulProcessor):
    """A chain of timers for one shard: each window's end closes it and awaits the next one."""

    def __init__(self, origin: int, length: int):
        self.origin, self.length = origin, length

    def _end_ms(self, window_no: int) -> int:
        """The first whole millisecond at which the window has ended."""
        return -(-(self.origin + window_no * self.length) // 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "window_no BIGINT", "rows BIGINT")
        self.next = handle.getValueState("next", "window_no BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found: dict[int, int] = {}
        for part in rows:
            for window_no, count in part["window_no"].value_counts().items():
                found[int(window_no)] = found.get(int(window_no), 0) + int(count)
        watermark = timerValues.getCurrentWatermarkInMs()
        found = {no: count for no, count in found.items() if self._end_ms(no) > watermark}
        if found:
            for no, count in found.items():
                before = self.counts.getValue((no,)) if self.counts.containsKey((no,)) else (0,)
                self.counts.updateValue((no,), (before[0] + count,))
            awaited = self.next.get()
            first = min(found)
            if awaited is None or first < awaited[0]:
                if awaited is not None:
                    self.handle.deleteTimer(self._end_ms(awaited[0]))
                self._await(first)
        return iter(())

    def _await(self, window_no: int) -> None:
        self.next.update((window_no,))
        self.handle.registerTimer(self._end_ms(window_no))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        first = self.next.get()[0]
        # The watermark may have passed many windows at once.
        stop = max(first, (watermark * 1000 - self.origin) // self.length + 1)
        for start in range(first, stop, ROWS_AT_ONCE):
            numbers = range(start, min(stop, start + ROWS_AT_ONCE))
            yield pd.DataFrame({"window_no": numbers, "rows": [self._taken(no) for no in numbers]})
        self._await(stop)

    def _taken(self, window_no: int) -> int:
        if not self.counts.containsKey((window_no,)):
            return 0
        count = self.counts.getValue((window_no,))[0]
        self.counts.removeKey((window_no,))
        return count


def closing_windows(
    stream: DataFrame, ts: str, spec: WindowSpec, delay: str = "10 seconds", shards: int = SHARDS
) -> DataFrame:
    """``window_no`` and ``rows`` per shard, as windows close: the ones without rows, too.

    Rows are dealt to shards by all their columns, so that a busy window is not one task.
    A window closes when the watermark, ``delay`` behind the last row, reaches its end; all
    shards close it in the same micro-batch. A shard starts with its first window. Rows
    that come later are left out, as are rows without a time.
    """
    origin = fixed_origin(spec)
    start = spec.start_of(stream, ts)
    shard = F.pmod(F.xxhash64(*stream.columns), F.lit(shards)).alias("shard")
    timed = stream.where(F.col(ts).isNotNull()).select(shard, F.col(ts).cast("timestamp").alias("ts"), F.col(ts).alias("own"))
    numbered = _numbered(timed.withWatermark("ts", delay), "own", start, spec.duration)
    return numbered.select("shard", "ts", "window_no").groupBy("shard").transformWithStateInPandas(
        _Rotation(micros(origin), spec.duration // timedelta(microseconds=1)), CLOSED, "append", "eventTime"
    )


def follow_windows_with_empty(
    stream: DataFrame,
    ts: str,
    spec: WindowSpec,
    path: str,
    checkpoint: str,
    delay: str = "10 seconds",
    shards: int = SHARDS,
    every: timedelta = DEFAULT_DURATION,
    available_now: bool = False,
) -> StreamingQuery:
    """Write every window that closes once, with its rows, to a directory per micro-batch.

    The windows are those of :func:`~sluiceway.operators.windows.windows_with_empty`, from
    the one of the first row on. After a silent gap its windows follow with no rows. What
    the state holds is a number for each shard and open window.
    """
    closing = closing_windows(stream, ts, spec, delay, shards)
    origin = F.lit(fixed_origin(spec).isoformat(sep=" ")).cast(stream.schema[ts].dataType)

    def handle(df: DataFrame, batch_id: int) -> None:
        totals = df.groupBy("window_no").agg(F.sum("rows").alias("rows"))
        described = _described(totals, origin, spec.duration)
        described.write.mode("overwrite").parquet(batch_path(path, batch_id))

    with timed_state(stream.sparkSession):
        return for_each_window(closing, handle, checkpoint, every, available_now)


def window_batch_counts(
    stream: DataFrame, ts: str, batch: str, spec: WindowSpec, delay: str = "10 seconds"
) -> DataFrame:
    """Rows per window and batch of a stream, kept as state until the window closes."""
    length = spec.duration // timedelta(microseconds=1)
    shift = micros(fixed_origin(spec)) % length
    timed = stream.select(F.col(ts).cast("timestamp").alias("ts"), F.col(batch).alias("batch"))
    window = F.window("ts", f"{length} microseconds", f"{length} microseconds", f"{shift} microseconds")
    counts = timed.withWatermark("ts", delay).groupBy(window.alias("w"), "batch").agg(F.count("*").alias("rows"))
    return counts.select(F.col("w.start").alias("window_start"), "batch", "rows")


def open_windows(spark: SparkSession, checkpoint: str, spec: WindowSpec) -> DataFrame:
    """``window_no``, ``window_id``, ``batches`` and ``rows`` of the windows not closed yet.

    Reads the state of a query over :func:`window_batch_counts` as its last finished
    micro-batch left it, while the query runs or after it has stopped. A batch without an
    id is not counted, its rows are.
    """
    state = spark.read.format("statestore").load(checkpoint)
    key, value = (state.schema[name].dataType.names for name in ("key", "value"))
    window, batch = (F.col("key").getField(name) for name in key)
    length = spec.duration // timedelta(microseconds=1)
    age = F.unix_micros(window.getField("start")) - F.lit(micros(fixed_origin(spec)))
    rows = state.select(
        (F.call_function("div", age, F.lit(length)) + 1).alias("window_no"),
        batch.alias("batch"),
        F.col("value").getField(value[-1]).alias("n"),
    )
    return (
        rows.groupBy("window_no")
        .agg(F.count_distinct("batch").alias("batches"), F.sum("n").alias("rows"))
        .select(
            "window_no", F.concat(F.lit("window-"), F.col("window_no")).alias("window_id"), "batches", "rows"
        )
    )


def open_window(spark: SparkSession, checkpoint: str, spec: WindowSpec) -> DataFrame:
    """The open window of a stream, the last one: its id, batches and rows, at most one row."""
    last = open_windows(spark, checkpoint, spec).orderBy(F.col("window_no").desc()).limit(1)
    return last.select("window_id", "batches", "rows")

"""Early, on-time and late results of the windows of a stream."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

DISCARDING, ACCUMULATING, RETRACTING = "discarding", "accumulating", "retracting"
MODES = (DISCARDING, ACCUMULATING, RETRACTING)
EARLY, ON_TIME, LATE = "early", "on_time", "late"
MEASURES = ["rows", "total"]


class _Panes(StatefulProcessor):
    """One window of one key: what came in, what was given out, and two timers.

    The watermark of the query lies ``lateness`` behind the one that makes a window on time.
    """

    def __init__(self, length: int, lateness: int, mode: str, early: bool):
        self.length, self.lateness, self.mode, self.early = length, lateness, mode, early

    def init(self, handle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "rows BIGINT, total BIGINT")
        self.given = handle.getValueState("given", "rows BIGINT, total BIGINT, firings INT")
        self.passed = handle.getValueState("passed", "on_time BOOLEAN")

    def _ends(self, key: tuple) -> tuple[int, int]:
        """Milliseconds of the query's watermark: window on time, and window closed."""
        end = -(-(key[1] + self.length) // 1000)
        return end - self.lateness, end

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        count = total = 0
        for part in rows:
            count += len(part)
            total += int(part["value"].fillna(0).sum())
        watermark = timerValues.getCurrentWatermarkInMs()
        on_time, closed = self._ends(key)
        if closed <= watermark or not count:
            return
        before = self.sums.get()
        if before is None:
            before = (0, 0)
            # After its time a window that had no rows has no result on time.
            late = on_time <= watermark and watermark > 0
            self.passed.update((late,))
            if not late:
                self.handle.registerTimer(max(on_time, 1))
            if on_time != closed or late:
                self.handle.registerTimer(closed)
        self.sums.update((before[0] + count, before[1] + total))
        if self.passed.get()[0]:
            yield self._fire(LATE)
        elif self.early:
            yield self._fire(EARLY)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, closed = self._ends(key)
        if not self.passed.get()[0]:
            self.passed.update((True,))
            yield self._fire(ON_TIME)
        if expiredTimerInfo.getExpiryTimeInMs() >= closed:
            for state in (self.sums, self.given, self.passed):
                state.clear()

    def _fire(self, pane: str) -> pd.DataFrame:
        rows, total = self.sums.get()
        given = self.given.get()
        old_rows, old_total, firings = given if given is not None else (0, 0, 0)
        self.given.update((rows, total, firings + 1))
        if self.mode == DISCARDING:
            out = [(rows - old_rows, total - old_total)]
        else:
            out = [(rows, total)]
            if self.mode == RETRACTING and firings:
                out.insert(0, (-old_rows, -old_total))
        found = pd.DataFrame(out, columns=MEASURES)
        found.insert(0, "firing", firings + 1)
        found.insert(0, "pane", pane)
        return found


class _Keyed(_Panes):
    """Adds the key and the window to what is given out."""

    def _named(self, key: tuple, found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in found:
            part.insert(0, "start", key[1])
            part.insert(0, "k", [key[0]] * len(part))
            yield part

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._named(key, super().handleInputRows(key, rows, timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._named(key, super().handleExpiredTimer(key, timerValues, expiredTimerInfo))


def firings(
    stream: DataFrame,
    ts: str,
    key: str,
    value: str,
    duration: timedelta,
    delay: timedelta = timedelta(seconds=10),
    lateness: timedelta = timedelta(0),
    mode: str = ACCUMULATING,
    early: bool = True,
) -> DataFrame:
    """Results of each key and epoch-aligned window: key, window_start, window_end, ``pane``,
    ``firing`` (from 1), ``rows`` and ``total``, the sum of the BIGINT ``value``.

    A window fires ``early`` in every micro-batch that brings it rows, once ``on_time`` when
    the watermark, ``delay`` behind the last row, reaches its end, and ``late`` for rows that
    come up to ``lateness`` after. Then its state goes, and rows that come later are dropped
    and counted in the progress of the query. ``discarding`` gives what came since the last
    firing, ``accumulating`` all of it, and ``retracting`` first takes back the last result
    in a row of negative numbers; over the rows of a window, discarding and retracting add
    up to its answer. A window first seen after its time has only late firings. Rows without
    a key or time are left out; a null value adds nothing. Start the query inside
    :func:`~sluiceway.streaming.state.timed_state`, in append mode.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    if not isinstance(stream.schema[value].dataType, (T.LongType, T.IntegerType)):
        raise ValueError(f"Column {value} must be a whole number")
    length = duration // timedelta(microseconds=1)
    if length < 1:
        raise ValueError("a window must have a positive duration")
    wait = (delay + lateness) // timedelta(milliseconds=1)
    rows = stream.select(
        F.col(key).alias("k"), F.col(ts).cast("timestamp").alias("at"), F.col(value).cast("bigint").alias("value")
    ).where(F.col("k").isNotNull() & F.col("at").isNotNull())
    at = F.unix_micros("at")
    placed = rows.withColumn("start", at - F.pmod(at, F.lit(length))).withWatermark("at", f"{wait} milliseconds")
    found = T.StructType(
        [
            T.StructField("k", stream.schema[key].dataType),
            *T.StructType.fromDDL("start BIGINT, pane STRING, firing INT, rows BIGINT, total BIGINT").fields,
        ]
    )
    panes = _Keyed(length, lateness // timedelta(milliseconds=1), mode, early)
    fired = placed.groupBy("k", "start").transformWithStateInPandas(panes, found, "append", "eventTime")
    return fired.select(
        F.col("k").alias(key),
        F.timestamp_micros("start").alias("window_start"),
        F.timestamp_micros(F.col("start") + length).alias("window_end"),
        "pane",
        "firing",
        *MEASURES,
    )

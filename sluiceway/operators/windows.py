"""Tumbling windows by arrival time, by event time and by count.

Arrival windows start at an origin (the first arrival unless given), are numbered from 1
and are half-open: a row at exactly the end belongs to the next window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.operators.ordinals import with_ordinal

DEFAULT_DURATION = timedelta(seconds=15)
SPINE_CHUNK = 100_000


@dataclass(frozen=True)
class WindowSpec:
    """Length of the windows, and where the first one starts: a time, or a column with one
    such as the first arrival in another DataFrame, or by default the first arrival."""

    duration: timedelta = DEFAULT_DURATION
    origin: datetime | Column | None = None

    def __post_init__(self) -> None:
        if self.duration <= timedelta(0):
            raise ValueError("a window must have a positive duration")

    def start_of(self, df: DataFrame, ts: str) -> Column:
        if self.origin is None:
            return first_arrival(df, ts)
        if isinstance(self.origin, Column):
            return self.origin
        return F.lit(self.origin.isoformat(sep=" ")).cast(df.schema[ts].dataType)


def first_arrival(df: DataFrame, ts: str) -> Column:
    return df.select(F.min(ts)).scalar()


def arrival_windows(df: DataFrame, ts: str, spec: WindowSpec = WindowSpec()) -> DataFrame:
    """Add ``window_no``, ``window_id``, ``window_start`` and ``window_end``."""
    origin = spec.start_of(df, ts)
    return _described(_numbered(df, ts, origin, spec.duration), origin, spec.duration)


def _numbered(df: DataFrame, ts: str, origin: Column, duration: timedelta) -> DataFrame:
    # A column of its own, so that the origin, mostly a subquery, is named only once.
    aged = df.withColumn("_age", F.col(ts) - origin)
    age, length = F.col("_age"), F.lit(duration)
    whole = F.call_function("div", age, length)
    # div rounds toward zero; before the origin it must round down.
    rounded_up = (age < F.lit(timedelta(0))) & (length * whole != age)
    number = F.when(rounded_up, whole).otherwise(whole + 1)
    return aged.withColumn("window_no", number).drop("_age")


def _described(df: DataFrame, origin: Column, duration: timedelta) -> DataFrame:
    length, number = F.lit(duration), F.col("window_no")
    return (
        df.withColumn("window_id", F.concat(F.lit("window-"), number.cast("string")))
        .withColumn("window_start", origin + length * (number - 1))
        .withColumn("window_end", F.col("window_start") + length)
    )


def window_stats(
    df: DataFrame, ts: str, batch: str, spec: WindowSpec = WindowSpec()
) -> DataFrame:
    """Rows and distinct batches of every window that has rows."""
    origin = spec.start_of(df, ts)
    stats = (
        _numbered(df.select(ts, batch).where(F.col(ts).isNotNull()), ts, origin, spec.duration)
        .groupBy("window_no")
        .agg(F.count("*").alias("rows"), F.count_distinct(batch).alias("batches"))
    )
    return _described(stats, origin, spec.duration)


def current_window(
    df: DataFrame, ts: str, batch: str, spec: WindowSpec = WindowSpec()
) -> DataFrame:
    """The open window, the last one: its id, batches and rows."""
    stats = window_stats(df, ts, batch, spec)
    last = stats.orderBy(F.col("window_no").desc()).limit(1)
    return last.select("window_id", "batches", "rows")


def is_expired(window_start: Column, duration: timedelta, as_of: Column) -> Column:
    return as_of - window_start >= F.lit(duration)


def closed_windows(
    df: DataFrame, ts: str, spec: WindowSpec = WindowSpec(), as_of: datetime | None = None
) -> DataFrame:
    """Windows with rows whose age at ``as_of`` (the last arrival unless given) has
    reached the duration."""
    if as_of is None:
        now = df.select(F.max(ts)).scalar()
    else:
        now = F.lit(as_of.isoformat(sep=" ")).cast(df.schema[ts].dataType)
    origin = spec.start_of(df, ts)
    counts = (
        _numbered(df.select(ts).where(F.col(ts).isNotNull()), ts, origin, spec.duration)
        .groupBy("window_no")
        .agg(F.count("*").alias("rows"))
    )
    windows = _described(counts, origin, spec.duration)
    return windows.filter(is_expired(F.col("window_start"), spec.duration, now))


def windows_with_empty(df: DataFrame, ts: str, spec: WindowSpec = WindowSpec()) -> DataFrame:
    """Rows of every window from the lowest to the highest, empty ones included.

    The numbers of all windows are produced in chunks, which are dealt to as many tasks as
    the session has cores, and join the row counts in one aggregation instead of a join.
    """
    origin = spec.start_of(df, ts)
    timed = df.select(ts).where(F.col(ts).isNotNull())
    found = _numbered(timed, ts, origin, spec.duration).select("window_no", F.lit(1).alias("n"))
    ends = []
    for name, end in (("first", F.min(ts)), ("last", F.max(ts))):
        numbered = _numbered(timed.agg(end.alias("ts")), "ts", origin, spec.duration)
        ends.append(numbered.select(F.col("window_no").alias(name)))
    chunk, first_chunk = F.lit(SPINE_CHUNK), F.lit(0).cast("bigint")
    last_chunk = F.call_function("div", F.col("last") - F.col("first"), chunk)
    # Two aggregates without keys: one row each. Without a timed row there is no window.
    chunks = (
        ends[0]
        .withColumn("one", F.lit(1))
        .join(ends[1].withColumn("one", F.lit(1)), "one")
        .where("last IS NOT NULL")
        .select("first", "last", F.explode(F.sequence(first_chunk, last_chunk)).alias("chunk"))
    )
    first_no = F.col("first") + F.col("chunk") * chunk
    # With a number, or adaptive execution would merge the chunks, small as they are.
    tasks = max(2, df.sparkSession.sparkContext.defaultParallelism)
    spine = chunks.repartition(tasks, "chunk").select(
        F.explode(F.sequence(first_no, F.least(first_no + chunk - 1, "last"))).alias("window_no"),
        F.lit(0).alias("n"),
    )
    counts = found.unionByName(spine).groupBy("window_no").agg(F.sum("n").alias("rows"))
    return _described(counts, origin, spec.duration)


def null_time_report(df: DataFrame, ts: str) -> DataFrame:
    """One row: how many rows have a time, and how many the windows leave out without one."""
    return df.agg(
        F.count_if(F.col(ts).isNotNull()).alias("timed_rows"),
        F.count_if(F.col(ts).isNull()).alias("null_time_rows"),
    )


def _with_key_and_time(df: DataFrame, ts: str, key: str) -> DataFrame:
    return df.select(ts, key).where(F.col(key).isNotNull() & F.col(ts).isNotNull())


def window_partition_stats(
    df: DataFrame, ts: str, key: str, spec: WindowSpec = WindowSpec()
) -> DataFrame:
    """Rows per window and key; rows without a key or a time are left out."""
    origin = spec.start_of(df, ts)
    counts = (
        _numbered(_with_key_and_time(df, ts, key), ts, origin, spec.duration)
        .groupBy("window_no", key)
        .agg(F.count("*").alias("rows"))
    )
    return _described(counts, origin, spec.duration)


def tumbling(df: DataFrame, ts: str, duration: timedelta = DEFAULT_DURATION) -> DataFrame:
    """Rows per epoch-aligned event-time window; works on batches and on streams."""
    width = f"{duration // timedelta(microseconds=1)} microseconds"
    counts = df.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("rows"))
    return counts.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "rows"
    )


def count_windows(
    df: DataFrame,
    size: int,
    order_by: list[str],
    start: int = 0,
    then: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add ``ordinal`` and ``batch_no``: every ``size`` rows in order form one batch, from 0.

    ``start`` is the number of rows before these. ``then`` is applied once to the rows in
    order before they are counted: give raw messages here and parse them there.
    """
    if size < 1:
        raise ValueError("a count window holds at least one row")
    numbered = with_ordinal(df, order_by, then=then).withColumn("ordinal", F.col("ordinal") + start)
    batch_no = F.call_function("div", F.col("ordinal") - 1, F.lit(size))
    return numbered.withColumn("batch_no", batch_no)

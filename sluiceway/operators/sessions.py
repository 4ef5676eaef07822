"""Session windows: rows of a key that follow each other within a gap belong together."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.operators.windows import WindowSpec, _described, _numbered

GAPS_A_SLICE = 256
EPOCH = datetime(1970, 1, 1)


def _width(gap: timedelta) -> str:
    if gap <= timedelta(0):
        raise ValueError("a session needs a positive gap")
    return f"{gap // timedelta(microseconds=1)} microseconds"


def _measures(gap: timedelta) -> list[Column]:
    """Bounds as aggregates: a filter on those of the window itself, which is a grouping
    column, would be applied to single rows before they are merged."""
    return [
        F.min("at").alias("session_start"),
        (F.max("at") + F.lit(gap)).alias("session_end"),
        F.count("*").alias("rows"),
    ]


def sessions(
    df: DataFrame, ts: str, key: str, gap: timedelta, span: timedelta | None = None
) -> DataFrame:
    """One row per session: ``key``, ``session_start``, ``session_end`` and ``rows``.

    A session ends ``gap`` after its last row; a row at exactly that time still belongs to
    it. Rows without a key or a time are left out. Sessions are first merged inside slices
    of time of length ``span`` (256 gaps unless given), so that a key with very many rows
    is spread over tasks. Only the first and the last session of a slice can go on in the
    next one; those are merged in a second step, two rows at most for a slice and key.
    """
    width = _width(gap)
    span = span or GAPS_A_SLICE * gap
    if span < 2 * gap:
        raise ValueError("a slice must be at least two gaps long")
    spec = WindowSpec(span, EPOCH)
    origin = spec.start_of(df, ts)
    timed = df.select(F.col(key).alias("k"), F.col(ts).alias("at"))
    timed = timed.where(F.col("k").isNotNull() & F.col("at").isNotNull())
    local = (
        _numbered(timed, "at", origin, span)
        .groupBy("k", "window_no", F.session_window("at", width).alias("s"))
        .agg(*_measures(gap))
        .drop("s")
    )
    starts_at_edge = F.col("session_start") <= F.col("window_start") + F.lit(gap)
    ends_at_edge = F.col("session_end") >= F.col("window_end")
    found = _described(local, origin, span).withColumn("edge", starts_at_edge | ends_at_edge)
    names = [F.col("k").alias(key), "session_start", "session_end", "rows"]
    whole = found.where(~F.col("edge"))
    return whole.select(*names).unionAll(_merged(found.where("edge")).select(*names))


def _merged(edges: DataFrame) -> DataFrame:
    """Merge sessions of a key that overlap or touch."""
    of_key = Window.partitionBy("k").orderBy("session_start")
    before = of_key.rowsBetween(Window.unboundedPreceding, -1)
    apart = F.col("session_start") > F.max("session_end").over(before)
    numbered = edges.withColumn("apart", F.when(apart, 1).otherwise(0)).withColumn(
        "number", F.sum("apart").over(of_key.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy("k", "number").agg(
        F.min("session_start").alias("session_start"),
        F.max("session_end").alias("session_end"),
        F.sum("rows").alias("rows"),
    )


def session_counts(
    stream: DataFrame, ts: str, key: str, gap: timedelta, delay: str = "10 seconds"
) -> DataFrame:
    """Sessions of a stream, each given once when the watermark has passed its end.

    For append mode. Rows more than ``delay`` behind are dropped and counted in the progress
    of the query. Rows of a task are merged before they travel if
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` is set.
    """
    timed = stream.where(F.col(key).isNotNull()).select(
        F.col(key).alias("k"), F.col(ts).cast("timestamp").alias("at")
    )
    counts = (
        timed.withWatermark("at", delay)
        .groupBy("k", F.session_window("at", _width(gap)).alias("s"))
        .agg(*_measures(gap))
    )
    return counts.select(F.col("k").alias(key), "session_start", "session_end", "rows")

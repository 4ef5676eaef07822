"""Sliding windows put together from panes, so that rows are not copied into every window."""

from __future__ import annotations

from datetime import timedelta
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How the parts of a measure go together.
MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
FIRST = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


def pane_length(duration: timedelta, slide: timedelta) -> timedelta:
    """The longest pane of which both whole windows and whole slides consist."""
    if min(duration, slide) <= timedelta(0):
        raise ValueError("a window must have a positive duration and slide")
    micro = timedelta(microseconds=1)
    return gcd(duration // micro, slide // micro) * micro


def _micros(length: timedelta) -> str:
    return f"{length // timedelta(microseconds=1)} microseconds"


def sliding(
    df: DataFrame,
    ts: str,
    duration: timedelta,
    slide: timedelta,
    measures: dict[str, tuple[str, str]] | None = None,
    by: tuple[str, ...] = (),
    delay: str | None = None,
) -> DataFrame:
    """Windows of ``duration`` that start every ``slide`` from the epoch, with their ``rows``.

    ``measures`` names further columns as (``count``, ``sum``, ``min`` or ``max``, column).
    Each row is added to one pane; panes, not rows, are then added to the windows that they
    lie in. Rows without a time are left out, and so are those between windows if the slide
    is longer than the duration. On a stream give ``delay``: a window is given once, when
    the watermark has passed its end (append mode).
    """
    measures = {"rows": ("count", "*"), **(measures or {})}
    unknown = {kind for kind, _ in measures.values()} - MERGE.keys()
    if unknown:
        raise ValueError(f"measures can be {sorted(MERGE)}, not {sorted(unknown)}")
    timed = df
    if delay is not None:
        timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    pane = F.window(ts, _micros(pane_length(duration, slide))).alias("pane")
    panes = timed.groupBy(pane, *by).agg(
        *(FIRST[kind](column).alias(name) for name, (kind, column) in measures.items())
    )
    if slide > duration:
        # Every slide starts one window, and panes behind its end are in none.
        panes = panes.select("*", F.window(F.window_time("pane"), _micros(slide)).alias("w"))
        panes = panes.where(F.col("pane.start") < F.col("w.start") + F.lit(duration))
        whole: Column = F.col("w")
    else:
        whole = F.window(F.window_time("pane"), _micros(duration), _micros(slide)).alias("w")
    merged = panes.groupBy(whole, *by).agg(
        *(MERGE[kind](name).alias(name) for name, (kind, _) in measures.items())
    )
    return merged.select(
        F.col("w.start").alias("window_start"),
        (F.col("w.start") + F.lit(duration)).alias("window_end"),
        *by,
        *measures,
    )

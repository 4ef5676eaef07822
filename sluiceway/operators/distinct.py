"""Exact distinct counts that can be merged over windows, kept as bitmaps."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.operators.windows import DEFAULT_DURATION


def _micros(length: timedelta) -> str:
    return f"{length // timedelta(microseconds=1)} microseconds"


def window_bitmaps(
    df: DataFrame, ts: str, value: str, duration: timedelta = DEFAULT_DURATION
) -> DataFrame:
    """``window_start``, ``bucket`` and ``bits``: which values each epoch-aligned window has.

    A bitmap holds 32,768 neighbouring values of a whole-number column in 4 KB, so this suits
    ids that lie close together. Tasks build bitmaps of their own rows before they travel.
    Rows without a time or a value are left out.
    """
    if not isinstance(df.schema[value].dataType, (T.LongType, T.IntegerType)):
        raise ValueError(f"Column {value} must be a whole number")
    rows = df.where(F.col(value).isNotNull()).select(F.col(ts).alias("at"), F.col(value).alias("v"))
    start = F.window("at", _micros(duration)).alias("w")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits")
    found = rows.groupBy(start, F.bitmap_bucket_number("v").alias("bucket")).agg(bits)
    return found.select(F.col("w.start").alias("window_start"), "bucket", "bits")


def merge_bitmaps(bitmaps: DataFrame, duration: timedelta) -> DataFrame:
    """Bitmaps of longer windows, of which the given ones are whole parts."""
    longer = F.window("window_start", _micros(duration)).alias("w")
    merged = bitmaps.groupBy(longer, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.select(F.col("w.start").alias("window_start"), "bucket", "bits")


def distinct_counts(bitmaps: DataFrame) -> DataFrame:
    """``window_start`` and ``distinct_values``."""
    counted = F.sum(F.bitmap_count("bits")).alias("distinct_values")
    return bitmaps.groupBy("window_start").agg(counted)

"""Running numbers 1, 2, 3, ... over a whole table or inside each key, at any skew.

A window function without ``partitionBy``, or over one very large key, would sort
all those rows in a single task. Here all rows are range-partitioned on their order,
numbered inside each range, and shifted by what lies in the ranges before. The one way
serves keys of all sizes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.session import stored

_POSITION_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def with_ordinal(
    df: DataFrame,
    order_by: list[str],
    partition_by: list[str] | None = None,
    name: str = "ordinal",
    then: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add ``name``, the 1-based position in ``order_by``, restarting for every key.

    ``order_by`` must order the rows totally (end it with a unique column). ``then`` is
    applied to the ordered rows before they are numbered, and may drop rows or change
    other columns than those named here: the bounds of the ranges are sampled without it,
    so that an expensive step runs once.
    """
    rows = _in_ranges(df, [*(partition_by or []), *order_by], then)
    columns = [c for c in rows.columns if c not in ("_row", "_part")]
    if name in columns:
        raise ValueError(f"Column {name} already exists")
    return (_inside_keys(rows, partition_by, name) if partition_by else _overall(rows, name)).select(
        *columns, name
    )


def _in_ranges(
    df: DataFrame, order: list[str], then: Callable[[DataFrame], DataFrame] | None
) -> DataFrame:
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    if then is not None:
        ranged = then(ranged)
    # Stored, because range bounds are sampled and may differ when computed again.
    rows = stored(ranged.withColumn("_row", F.monotonically_increasing_id()), "ordinals")
    return rows.withColumn("_part", F.shiftrightunsigned("_row", _POSITION_BITS))


def _overall(rows: DataFrame, name: str) -> DataFrame:
    position = F.col("_row").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)) + 1
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, so the single-task running sum stays as small as the range count.
    offsets = (
        rows.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + position)


def _inside_keys(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Number each key inside a range, whose rows one task held already; then carry over.

    Only the first key of a range can go on from ranges before, all of which end with it.
    """
    key = F.struct(*keys)
    # The largest key with its first row: rows lie in order, so the rest of the range has it.
    ends = rows.groupBy("_part").agg(
        F.min(key).alias("_first"),
        F.max(F.struct(key.alias("key"), (-F.col("_row")).alias("back"))).alias("_last"),
        F.max("_row").alias("_end"),
    )
    # Two rows per range from here on.
    asks = F.struct(F.col("_first").alias("_key"), F.lit(0).cast("bigint").alias("_rows"), F.lit(True).alias("_asks"))
    in_last = F.col("_end") + F.col("_last.back") + 1
    gives = F.struct(F.col("_last.key").alias("_key"), in_last.alias("_rows"), F.lit(False).alias("_asks"))
    before = Window.partitionBy("_key").orderBy("_part").rangeBetween(Window.unboundedPreceding, -1)
    carried = (
        ends.select("_part", F.inline(F.array(asks, gives)))
        .withColumn("_carry", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .where("_asks")
        .select("_part", "_carry")
    )
    inside = Window.partitionBy("_part", *keys).orderBy("_row")
    numbered = rows.withColumn("_inside", F.row_number().over(inside)).join(F.broadcast(carried), "_part")
    # A row of the range's first key is as far into the range as into its key.
    of_first = F.col("_inside") == F.col("_row").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)) + 1
    carry = F.when(of_first, F.col("_carry")).otherwise(F.lit(0))
    return numbered.withColumn(name, (F.col("_inside") + carry).cast("bigint"))


def with_next(
    df: DataFrame, order_by: list[str], partition_by: list[str], value: str, name: str
) -> DataFrame:
    """Add ``name``, the ``value`` of the next row of the same key; null for the last one.

    ``order_by`` must order the rows of a key totally.
    """
    rows = _in_ranges(df, [*partition_by, *order_by], None)
    columns = [c for c in rows.columns if c not in ("_row", "_part")]
    if name in columns:
        raise ValueError(f"Column {name} already exists")
    key = F.struct(*partition_by)
    # What every range begins with, seen from the one before. One row per range.
    first = rows.groupBy("_part").agg(
        F.min_by(F.struct(key.alias("key"), F.col(value).alias("value")), "_row").alias("_first")
    )
    later = stored(
        first.select("_part", F.lead("_first").over(Window.orderBy("_part")).alias("_later")), "later"
    )
    inside = Window.partitionBy("_part", *partition_by).orderBy("_row")
    followed = rows.withColumn("_next", F.lead("_row").over(inside)).withColumn(
        name, F.lead(value).over(inside)
    )
    carried = followed.join(F.broadcast(later), "_part")
    goes_on = F.col("_next").isNull() & key.eqNullSafe(F.col("_later.key"))
    return carried.withColumn(name, F.when(goes_on, F.col("_later.value")).otherwise(F.col(name))).select(
        *columns, name
    )

"""Change data: keep the changes of a key in timestamp order, and reduce them to the last one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.operators.ordinals import with_next, with_ordinal
from sluiceway.operators.split import keyed, split_in_order


def cdc_split(df: DataFrame, key: str, ts: str, seq: str) -> DataFrame:
    """Sub-partition each key by timestamp: consecutive tasks hold consecutive changes."""
    return split_in_order(df, key, (ts, seq))


def cdc_order(
    df: DataFrame, key: str, ts: str, seq: str, name: str = "change_no"
) -> DataFrame:
    """Number the changes of each key by timestamp; ``seq`` decides between equal timestamps.

    Like every function here it leaves out changes without a key, which
    :func:`~sluiceway.operators.split.null_key_report` counts.
    """
    return with_ordinal(keyed(df, key), [ts, seq], [key], name)


def cdc_history(
    df: DataFrame, key: str, ts: str, seq: str, valid_to: str = "valid_to"
) -> DataFrame:
    """Add ``valid_to``, the time of the next change of the key; null while a change is valid.

    A change is valid from its own time; one of several at the same time has an empty span,
    but for the last by ``seq``. What the next range of rows begins with is carried back to
    the end of the one before, one row per range, so a key of any size is spread over tasks.
    """
    return with_next(keyed(df, key), [ts, seq], [key], ts, valid_to)


def last_changes(df: DataFrame, key: str, ts: str, seq: str) -> DataFrame:
    """The last change of every key, deletions included.

    Each task first reduces its own rows to one per key, so a key with very many
    changes costs no more to shuffle than any other.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    last = keyed(df, key).groupBy(key).agg(F.max_by(row, F.struct(ts, seq)).alias("last"))
    return last.select("last.*")


def cdc_latest(df: DataFrame, key: str, ts: str, seq: str, is_delete: Column) -> DataFrame:
    """The current row of every key whose last change is not a deletion."""
    return last_changes(df, key, ts, seq).filter(~F.coalesce(is_delete, F.lit(False)))

"""Split rows by an integer key, combine batches, and count keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.operators.ordinals import with_ordinal
from sluiceway.schema import partition_key, same_schema


def keyed(df: DataFrame, key: str) -> DataFrame:
    """Rows that have a key; :func:`null_key_report` counts the others."""
    return df.filter(F.col(partition_key(df, key)).isNotNull())


def split_by_key(
    df: DataFrame, key: str, order_by: tuple[str, ...] = (), salt: int = 1
) -> DataFrame:
    """Cluster the rows by ``key``, each task's rows sorted by key and then ``order_by``."""
    return clustered(keyed(df, key), [key], order_by, salt)


def clustered(
    df: DataFrame, keys: list[str], order_by: tuple[str, ...] = (), salt: int = 1
) -> DataFrame:
    """One shuffle that gathers equal ``keys``, then a sort inside every task.

    By default a rebalance: small keys share a task, and adaptive execution splits a key
    larger than its advisory partition size over several tasks. ``salt`` > 1 instead
    spreads every key over up to that many tasks by a hash of the row, for sessions
    without adaptive execution; equal rows stay together.
    """
    if salt > 1:
        spread = F.pmod(F.xxhash64(*(order_by or df.columns)), F.lit(salt))
        gathered = df.repartition(*keys, spread)
    else:
        gathered = df.hint("rebalance", *[F.col(key) for key in keys])
    return gathered.sortWithinPartitions(*keys, *order_by)


def split_in_order(df: DataFrame, key: str, order_by: tuple[str, ...]) -> DataFrame:
    """Like :func:`split_by_key`, but in range partitions of key and order.

    A large key then covers several consecutive tasks, and its order holds across them
    too, at the price of a sampling pass over the input.
    """
    rows = keyed(df, key)
    return rows.repartitionByRange(key, *order_by).sortWithinPartitions(key, *order_by)


def null_key_report(df: DataFrame, key: str) -> DataFrame:
    """One row: how many rows have a key, and how many were left out for a null one."""
    found = F.col(partition_key(df, key))
    return df.agg(
        F.count_if(found.isNotNull()).alias("keyed_rows"),
        F.count_if(found.isNull()).alias("null_key_rows"),
    )


def append_batches(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both, duplicates included; the schemas must be equal."""
    same_schema(first, second)
    return first.unionByName(second)


def partition_sizes(df: DataFrame, key: str) -> DataFrame:
    return keyed(df, key).groupBy(key).agg(F.count("*").alias("rows"))


def partition_count(df: DataFrame, key: str) -> DataFrame:
    return keyed(df, key).agg(F.count_distinct(key).alias("partitions"))


def partition_order(
    df: DataFrame, key: str, order_by: list[str], name: str = "position"
) -> DataFrame:
    """Number the rows inside each key in batch order, then row order."""
    return with_ordinal(keyed(df, key), order_by, [key], name)

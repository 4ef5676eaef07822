"""Tables for very many keys: a fixed number of sorted buckets instead of a directory a key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.operators.split import keyed
from sluiceway.schema import partition_key
from sluiceway.sinks.tables import BATCH, _quoted


def bucketed_table_sql(
    name: str, schema: T.StructType, key: str, buckets: int, location: str | None = None
) -> str:
    if buckets < 1:
        raise ValueError("a table has one bucket at least")
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    sql = (
        f"CREATE TABLE IF NOT EXISTS {_quoted(name)} ({columns}, `{BATCH}` BIGINT) USING parquet "
        f"PARTITIONED BY (`{BATCH}`) CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS"
    )
    if location:
        sql += " LOCATION '" + location.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return sql


def ensure_bucketed_table(
    spark: SparkSession,
    name: str,
    schema: T.StructType,
    key: str,
    buckets: int,
    mode: str = "if_not_exists",
    location: str | None = None,
) -> DataFrame:
    """Open a table with a batch per partition and ``buckets`` files per batch, creating it
    if needed; ``mode="replace"`` first drops what is there.

    A read for one key opens one bucket, and tables of as many buckets join on the key
    without a shuffle. A bucket should come to a few hundred MB per batch.
    """
    if mode not in ("if_not_exists", "replace"):
        raise ValueError(f"mode must be 'if_not_exists' or 'replace', not {mode!r}")
    partition_key(spark.createDataFrame([], schema), key)
    if mode == "replace":
        spark.sql(f"DROP TABLE IF EXISTS {_quoted(name)}")
    spark.sql(bucketed_table_sql(name, schema, key, buckets, location))
    return spark.table(_quoted(name))


def buckets_of(spark: SparkSession, name: str) -> int:
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {_quoted(name)}").where("col_name = 'Num Buckets'")
    row = described.first()
    if row is None:
        raise ValueError(f"{name} is not bucketed")
    return int(row["data_type"])


def overwrite_bucketed_batch(df: DataFrame, name: str, batch_id: int, key: str) -> None:
    """Make the batch in a table of :func:`ensure_bucketed_table`; a repeat adds no row.

    Rows travel once, to the task of their bucket, which writes one sorted file; a key with
    very many rows makes its bucket's file long. Rows without a key are left out.
    """
    spark = df.sparkSession
    columns = [c for c in spark.table(_quoted(name)).columns if c != BATCH]
    rows = keyed(df, key).repartition(buckets_of(spark, name), F.col(key)).sortWithinPartitions(key)
    view = f"batch_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(view)
    try:
        spark.sql(
            f"INSERT OVERWRITE TABLE {_quoted(name)} PARTITION (`{BATCH}` = {int(batch_id)}) "
            f"SELECT {', '.join(map(_quoted, columns))} FROM {view}"
        )
    finally:
        spark.catalog.dropTempView(view)

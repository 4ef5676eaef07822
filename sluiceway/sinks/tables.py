"""Partitioned tables: creation, repeatable writes per batch, retries, and a manifest."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.operators.split import clustered, keyed, split_by_key

log = logging.getLogger(__name__)

MAX_ATTEMPTS = 10
RETRY_DELAY = 0.1  # seconds, the same before every retry
BATCH = "batch_id"


class WriteFailed(RuntimeError):
    """A batch could not be written in any attempt."""


def rest_catalog_conf(
    catalog: str, uri: str, warehouse: str | None = None, **properties: str
) -> dict[str, str]:
    """Session settings for an Iceberg REST catalog (needs the Iceberg runtime).

    Further catalog properties, such as storage endpoint and credentials, are passed by
    name with ``_`` for ``-`` and ``__`` for ``.``, for example ``s3__endpoint=...``.
    """
    prefix = f"spark.sql.catalog.{catalog}"
    conf = {
        prefix: "org.apache.iceberg.spark.SparkCatalog",
        f"{prefix}.type": "rest",
        f"{prefix}.uri": uri,
    }
    if warehouse:
        conf[f"{prefix}.warehouse"] = warehouse
    for name, value in properties.items():
        conf[f"{prefix}.{name.replace('__', '.').replace('_', '-')}"] = value
    return conf


def commit_properties(
    max_attempts: int = MAX_ATTEMPTS, delay: float = RETRY_DELAY
) -> dict[str, str]:
    """Iceberg table properties with which the table format itself retries commits."""
    wait = str(int(delay * 1000))
    return {
        "commit.retry.num-retries": str(max_attempts - 1),
        "commit.retry.min-wait-ms": wait,
        "commit.retry.max-wait-ms": wait,
    }


def _quoted(name: str) -> str:
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


def create_table_sql(
    name: str,
    schema: T.StructType,
    key: str,
    fmt: str = "parquet",
    location: str | None = None,
    properties: dict[str, str] | None = None,
    outer: tuple[str, ...] = (),
) -> str:
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    sql = f"CREATE TABLE IF NOT EXISTS {_quoted(name)} ({columns}) USING {fmt}"
    sql += f" PARTITIONED BY ({', '.join(f'`{name}`' for name in (*outer, key))})"
    if location:
        sql += " LOCATION '" + location.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if properties:
        pairs = ", ".join(f"'{k}' = '{v}'" for k, v in properties.items())
        sql += f" TBLPROPERTIES ({pairs})"
    return sql


def ensure_table(
    spark: SparkSession,
    name: str,
    schema: T.StructType,
    key: str,
    mode: str = "if_not_exists",
    fmt: str = "parquet",
    location: str | None = None,
    properties: dict[str, str] | None = None,
    outer: tuple[str, ...] = (),
) -> DataFrame:
    """Open the table, creating it if needed; ``mode="replace"`` first drops what is there."""
    if mode not in ("if_not_exists", "replace"):
        raise ValueError(f"mode must be 'if_not_exists' or 'replace', not {mode!r}")
    namespace = name.rpartition(".")[0]
    if namespace:
        spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {_quoted(namespace)}")
    if mode == "replace":
        spark.sql(f"DROP TABLE IF EXISTS {_quoted(name)}")
    spark.sql(create_table_sql(name, schema, key, fmt, location, properties, outer))
    return spark.table(_quoted(name))


def overwrite_batch(
    df: DataFrame, name: str, batch_id: int, key: str, fmt: str = "parquet", salt: int = 1
) -> None:
    """Make the batch in a table that :func:`ensure_table` partitioned by ``batch_id`` first.

    Whatever the table has of this batch is replaced, so that a repeat adds no row.
    """
    spark = df.sparkSession
    columns = spark.table(_quoted(name)).columns
    rows = split_by_key(df, key, salt=salt).withColumn(BATCH, F.lit(batch_id).cast("bigint"))
    if fmt == "iceberg":
        rows.select(*columns).writeTo(_quoted(name)).overwrite(F.col(BATCH) == batch_id)
        return
    view = f"batch_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(view)
    partitions = [c for c in columns if c not in df.columns or c == key]
    dynamic = [f"`{c}`" for c in partitions if c != BATCH]
    data = [_quoted(c) for c in columns if c != BATCH and f"`{c}`" not in dynamic]
    try:
        # The batch is named, so exactly its keys go, those no longer there included.
        spark.sql(
            f"INSERT OVERWRITE TABLE {_quoted(name)} "
            f"PARTITION (`{BATCH}` = {batch_id}, {', '.join(dynamic)}) "
            f"SELECT {', '.join([*data, *dynamic])} FROM {view}"
        )
    finally:
        spark.catalog.dropTempView(view)


def append_table(df: DataFrame, name: str, key: str, fmt: str = "parquet", salt: int = 1) -> None:
    """Append to a table made by :func:`ensure_table`.

    Rows without a key are left out; ``null_key_report`` counts them.
    A repeat appends again: use :func:`overwrite_batch` for what may be repeated.
    """
    target = df.sparkSession.table(_quoted(name))
    rows = split_by_key(df, key, salt=salt).select(*target.columns)
    if fmt == "iceberg":
        rows.writeTo(_quoted(name)).append()
    else:
        rows.write.mode("append").insertInto(_quoted(name))


def write_partitioned(
    df: DataFrame,
    path: str,
    key: str,
    order_by: tuple[str, ...] = (),
    outer: tuple[str, ...] = (),
    mode: str = "append",
    salt: int = 1,
) -> None:
    """One Parquet write for all keys: a directory per key, below those of ``outer``."""
    rows = clustered(keyed(df, key), [*outer, key], order_by, salt)
    # Static, so that overwriting never leaves directories of keys that are gone.
    writer = rows.write.mode(mode).option("partitionOverwriteMode", "static")
    writer.partitionBy(*outer, key).parquet(path)


def batch_path(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/{BATCH}={batch_id}"


def with_retries(
    action: Callable[[], None], max_attempts: int = MAX_ATTEMPTS, delay: float = RETRY_DELAY
) -> tuple[int, Exception | None]:
    """Publish until it succeeds; the zero-based last attempt, and its error if that failed too.

    Only errors of storage are tried again. Any other is a fault of the data or the program,
    which a repeat does not mend, and is raised.
    """
    error: Exception | None = None
    for attempt in range(max_attempts):
        try:
            action()
            return attempt, None
        except Exception as failure:
            if not _of_storage(failure):
                raise
            log.warning("attempt %d of %d failed: %s", attempt + 1, max_attempts, failure)
            error = failure
            if attempt < max_attempts - 1:
                time.sleep(delay)
    return max_attempts - 1, error


def _of_storage(failure: Exception) -> bool:
    if isinstance(failure, OSError):
        return True
    cause = getattr(failure, "java_exception", None)
    while cause is not None:
        if "IOException" in cause.getClass().getName() or "FileSystem" in cause.getClass().getName():
            return True
        cause = cause.getCause()
    return False


def publish(spark: SparkSession, staged: str, target: str) -> None:
    """Put a finished directory in place of ``target`` by renaming it."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    source, goal = path(staged), path(target)
    files = goal.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(source):
        if files.exists(goal):  # renamed by an attempt that reported a failure
            return
        raise OSError(f"{staged} is gone")
    files.mkdirs(goal.getParent())
    if files.exists(goal) and not files.delete(goal, True):
        raise OSError(f"{target} could not be replaced")
    if not files.rename(source, goal):
        raise OSError(f"{staged} could not be renamed to {target}")


def write_batch(
    df: DataFrame,
    path: str,
    batch_id: int,
    key: str,
    max_attempts: int = MAX_ATTEMPTS,
    delay: float = RETRY_DELAY,
    order_by: tuple[str, ...] = (),
    salt: int = 1,
    outer: tuple[str, ...] = (),
) -> tuple[int, bool]:
    """Write one batch to a directory of its own, so that writing it again changes nothing.

    The rows are written once, to a directory that readers skip; only putting it in place is
    tried again. Rows without a key are left out; ``null_key_report`` counts them.
    """
    spark, target = df.sparkSession, batch_path(path, batch_id)
    staged = f"{path.rstrip('/')}/_staged-{batch_id}-{uuid.uuid4().hex}"
    write_partitioned(df, staged, key, order_by, outer, mode="overwrite", salt=salt)
    attempt, error = with_retries(lambda: publish(spark, staged, target), max_attempts, delay)
    if error is not None:
        log.error("batch %d stays in %s: %s", batch_id, staged, error)
    return attempt, error is None


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches below ``path``: the table's columns and ``batch_id``, typed as declared."""
    typed = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    return spark.read.schema(typed).parquet(path).select(*typed.names)


def written_files(table: DataFrame, key: str) -> DataFrame:
    """One row per file of a table read from files: path, key, rows."""
    return table.groupBy(F.col("_metadata.file_path").alias("path"), key).agg(
        F.count("*").alias("rows")
    )


def window_files(table: DataFrame, window: str, key: str) -> DataFrame:
    """One row per window, key and file that has rows of both: window, key, path, rows."""
    return table.groupBy(window, key, F.col("_metadata.file_path").alias("path")).agg(
        F.count("*").alias("rows")
    )


def manifest(table: DataFrame, key: str) -> DataFrame:
    """Files and rows per key of a table read from files."""
    return table.groupBy(key).agg(
        F.count_distinct(F.col("_metadata.file_path")).alias("files"),
        F.count("*").alias("rows"),
    )

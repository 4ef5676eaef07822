"""Keep the last change of every key of a stream, to be merged when it is read."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sluiceway.operators.cdc import cdc_latest, last_changes
from sluiceway.operators.windows import DEFAULT_DURATION
from sluiceway.sinks.tables import BATCH, batch_path, publish
from sluiceway.streaming.windows import for_each_window


UPTO = "upto"


def record_changes(df: DataFrame, batch_id: int, path: str, key: str, ts: str, seq: str) -> None:
    """Reduce a micro-batch to one change per key and store it; a repeat overwrites it."""
    last_changes(df, key, ts, seq).write.mode("overwrite").parquet(batch_path(path, batch_id))


def follow_changes(
    stream: DataFrame,
    path: str,
    key: str,
    ts: str,
    seq: str,
    checkpoint: str,
    every: timedelta = DEFAULT_DURATION,
    available_now: bool = False,
) -> StreamingQuery:
    """Run :func:`record_changes` on every window of a stream."""

    def handle(window: DataFrame, batch_id: int) -> None:
        record_changes(window, batch_id, path, key, ts, seq)

    return for_each_window(stream, handle, checkpoint, every, available_now)


def current_rows(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    key: str,
    ts: str,
    seq: str,
    is_delete: Column,
) -> DataFrame:
    """The rows that are not deleted, as of all changes recorded.

    Reads the last compaction and the batches after it.
    """
    return cdc_latest(_recorded(spark, path, schema), key, ts, seq, is_delete)


def compact_changes(
    spark: SparkSession, path: str, schema: T.StructType, key: str, ts: str, seq: str
) -> int:
    """Reduce what was recorded up to now to one change per key; the last batch it holds.

    The stream goes on recording meanwhile, and readers use the new compaction from their
    next read on. Deletions stay, so that an older change arriving later cannot bring a row
    back. Batches are left for readers under way; :func:`drop_compacted` deletes them.
    """
    upto = _newest(spark, path, BATCH)
    if upto is None or upto == _newest(spark, _compactions(path), UPTO):
        return -1 if upto is None else upto
    reduced = last_changes(_recorded(spark, path, schema, upto), key, ts, seq)
    staged = f"{_compactions(path)}/_staged-{uuid.uuid4().hex}"
    reduced.write.parquet(staged)
    publish(spark, staged, f"{_compactions(path)}/{UPTO}={upto}")
    return upto


def drop_compacted(spark: SparkSession, path: str) -> None:
    """Delete the batches that the last compaction holds, and the compactions before it."""
    upto = _newest(spark, _compactions(path), UPTO)
    for where, name, keep in ((path, BATCH, (upto or -1) + 1), (_compactions(path), UPTO, upto)):
        for number in _numbers(spark, where, name):
            if upto is not None and number < keep:
                target = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/{name}={number}")
                _files(spark, target).delete(target, True)


def _compactions(path: str) -> str:
    return f"{path.rstrip('/')}/_compacted"


def _recorded(
    spark: SparkSession, path: str, schema: T.StructType, upto: int | None = None
) -> DataFrame:
    """The last compaction and the batches after it, up to a batch if one is given."""
    base = _newest(spark, _compactions(path), UPTO)
    later = [n for n in _numbers(spark, path, BATCH) if base is None or n > base]
    later = [n for n in later if upto is None or n <= upto]
    folders = [batch_path(path, n) for n in later]
    if base is not None:
        folders.append(f"{_compactions(path)}/{UPTO}={base}")
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def _files(spark: SparkSession, target):
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the directories ``name=number`` in a folder: names only, no data."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = _files(spark, folder)
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return [int(n.partition("=")[2]) for n in names if n.startswith(f"{name}=")]


def _newest(spark: SparkSession, path: str, name: str) -> int | None:
    return max(_numbers(spark, path, name), default=None)

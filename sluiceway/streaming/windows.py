"""Windows of a stream: each micro-batch is one, or they follow event time or a count."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluiceway.operators.split import keyed
from sluiceway.operators.windows import DEFAULT_DURATION, count_windows, tumbling
from sluiceway.session import temporary_tables
from sluiceway.sinks.tables import batch_path

Handler = Callable[[DataFrame, int], None]


def window_id(batch_id: int) -> str:
    """The name of the arrival window that a micro-batch forms."""
    return f"window-{batch_id + 1}"


def for_each_window(
    stream: DataFrame,
    handler: Handler,
    checkpoint: str,
    every: timedelta = DEFAULT_DURATION,
    available_now: bool = False,
    name: str | None = None,
) -> StreamingQuery:
    """Collect arrivals for ``every`` and give each such window to ``handler(df, batch_id)``.

    A window whose handler fails is given again after a restart from ``checkpoint``.
    Stopping leaves unprocessed input in the source. ``available_now`` works off what
    is there and ends.
    """
    writer = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    if available_now:
        return writer.trigger(availableNow=True).start()
    interval = f"{every // timedelta(milliseconds=1)} milliseconds"
    return writer.trigger(processingTime=interval).start()


def event_time_counts(
    stream: DataFrame, ts: str, duration: timedelta = DEFAULT_DURATION, delay: str = "10 seconds"
) -> DataFrame:
    """Rows per event-time window; rows later than ``delay`` behind are dropped and counted
    in the progress of the query. For append mode."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return tumbling(timed, ts, duration)


def append_files(
    stream: DataFrame,
    path: str,
    key: str,
    checkpoint: str,
    available_now: bool = False,
    salt: int | None = None,
) -> StreamingQuery:
    """Append rows with a key to a partitioned Parquet directory, each exactly once.

    Unless ``salt`` is given there is no shuffle, and every task writes a file for each
    key it meets. With ``salt`` a key is gathered into up to that many files per batch.
    Rows without a key are left out; the progress of the query counts them as ``null_keys``.
    """
    no_key = F.count_if(F.col(key).isNull()).alias("null_keys")
    rows = keyed(stream.observe("left_out", no_key), key)
    if salt is not None:
        rows = rows.repartition(F.col(key), F.pmod(F.xxhash64(*rows.columns), F.lit(salt)))
    writer = rows.writeStream.format("parquet").option("path", path).partitionBy(key)
    writer = writer.option("checkpointLocation", checkpoint).outputMode("append")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def total_before(spark: SparkSession, path: str, batch_id: int) -> int:
    """How many messages the micro-batches before ``batch_id`` had."""
    if batch_id == 0:
        return 0
    before = spark.read.schema("total BIGINT").parquet(batch_path(path, batch_id - 1))
    return before.first()["total"]


def keep_total(spark: SparkSession, path: str, batch_id: int, total: int) -> None:
    row = spark.range(1).select(F.lit(total).cast("bigint").alias("total"))
    row.write.mode("overwrite").parquet(batch_path(path, batch_id))


def write_count_windows(
    df: DataFrame, batch_id: int, path: str, size: int, order_by: list[str]
) -> int:
    """Number the rows of a micro-batch after those of the ones before; the new total.

    Rows go to ``path/rows``, with ``ordinal`` and ``batch_no``, and the running total to
    ``path/totals``, each in a directory of the micro-batch, so that a repeat overwrites it.
    """
    spark = df.sparkSession
    start = total_before(spark, f"{path}/totals", batch_id)
    target = batch_path(f"{path}/rows", batch_id)
    with temporary_tables(spark):
        numbered = count_windows(df, size, order_by, start)
        numbered.write.mode("overwrite").parquet(target)
    total = start + spark.read.schema(numbered.schema).parquet(target).count()
    keep_total(spark, f"{path}/totals", batch_id, total)
    return total


def follow_count_windows(
    stream: DataFrame,
    path: str,
    size: int,
    order_by: list[str],
    checkpoint: str,
    every: timedelta = DEFAULT_DURATION,
    available_now: bool = False,
) -> StreamingQuery:
    """Run :func:`write_count_windows` on every micro-batch of a stream."""

    def handle(df: DataFrame, batch_id: int) -> None:
        write_count_windows(df, batch_id, path, size, order_by)

    return for_each_window(stream, handle, checkpoint, every, available_now)

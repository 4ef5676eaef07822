"""Keep late rows beside the others, by a watermark carried between micro-batches."""

from __future__ import annotations

from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sluiceway.operators.windows import DEFAULT_DURATION
from sluiceway.sinks.tables import BATCH, batch_path
from sluiceway.streaming.windows import for_each_window

IS_LATE = "is_late"


def last_seen(spark: SparkSession, path: str, batch_id: int) -> int | None:
    """Microseconds of the latest time in the micro-batches before ``batch_id``."""
    if batch_id == 0:
        return None
    before = spark.read.schema("micros BIGINT").parquet(batch_path(f"{path}/seen", batch_id - 1))
    return before.first()["micros"]


def divide_batch(df: DataFrame, batch_id: int, path: str, ts: str, delay: timedelta) -> int | None:
    """Write a micro-batch in one pass, its late rows apart; the latest time up to now.

    Late is what lies more than ``delay`` behind the latest time of the micro-batches before.
    A repeat overwrites.
    """
    if IS_LATE in df.columns:
        raise ValueError(f"Column {IS_LATE} already exists")
    spark = df.sparkSession
    seen = last_seen(spark, path, batch_id)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    behind = F.lit(False)
    if seen is not None:
        behind = micros < F.lit(seen - delay // timedelta(microseconds=1))
    found = Observation()
    rows = df.withColumn(IS_LATE, F.coalesce(behind, F.lit(True))).observe(found, F.max(micros).alias("last"))
    rows.write.partitionBy(IS_LATE).mode("overwrite").parquet(batch_path(f"{path}/rows", batch_id))
    times = [t for t in (seen, found.get["last"]) if t is not None]
    now = max(times, default=None)
    kept = spark.range(1).select(F.lit(now).cast("bigint").alias("micros"))
    kept.write.mode("overwrite").parquet(batch_path(f"{path}/seen", batch_id))
    return now


def follow_with_late(
    stream: DataFrame,
    ts: str,
    path: str,
    checkpoint: str,
    delay: timedelta = timedelta(seconds=10),
    every: timedelta = DEFAULT_DURATION,
    available_now: bool = False,
) -> StreamingQuery:
    """Append every row of a stream to the rows on time or to the late ones.

    The watermark is stored beside the rows and goes on after a restart. Inside a micro-batch
    no row makes another one late. Rows without a time are late: they belong to no window.
    """

    def handle(df: DataFrame, batch_id: int) -> None:
        divide_batch(df, batch_id, path, ts, delay)

    return for_each_window(stream, handle, checkpoint, every, available_now)


def _rows(spark: SparkSession, path: str, schema: T.StructType, late: bool) -> DataFrame:
    whole = T.StructType([*schema.fields, T.StructField(IS_LATE, T.BooleanType()), T.StructField(BATCH, T.LongType())])
    try:
        rows = spark.read.schema(whole).parquet(f"{path}/rows")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], whole)
    return rows.where(F.col(IS_LATE) == late).drop(IS_LATE)


def on_time_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows on time with their ``batch_id``; directories of late ones are not read."""
    return _rows(spark, path, schema, False)


def late_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The late rows with their ``batch_id``."""
    return _rows(spark, path, schema, True)

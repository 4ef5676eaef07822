"""Read messages from a replayable source, as a batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FILE_FORMATS = ("text", "parquet")


def kafka_options(
    servers: str, topic: str, starting: str = "earliest", max_per_batch: int | None = None
) -> dict[str, str]:
    """Options that subscribe to one topic.

    The position of a stream is kept in its checkpoint, which takes the place of a
    consumer group. ``max_per_batch`` limits a micro-batch.
    """
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
    }
    if max_per_batch is not None:
        options["maxOffsetsPerTrigger"] = str(max_per_batch)
    return options


def kafka_messages(spark: SparkSession, streaming: bool = True, **options) -> DataFrame:
    """Columns key, value, topic, partition, offset, timestamp (needs the Kafka connector)."""
    reader = spark.readStream if streaming else spark.read
    return reader.format("kafka").options(**kafka_options(**options)).load()


def file_messages(
    spark: SparkSession,
    path: str,
    fmt: str = "text",
    schema: T.StructType | str | None = None,
    streaming: bool = True,
    max_per_batch: int | None = None,
) -> DataFrame:
    """One message per line (``text``, column ``value``) or per row (``parquet``).

    ``max_per_batch`` limits the files of a micro-batch.
    """
    if fmt not in FILE_FORMATS:
        raise ValueError(f"fmt must be one of {FILE_FORMATS}, not {fmt!r}")
    if fmt == "parquet" and schema is None and streaming:
        raise ValueError("a stream of parquet files needs a schema")
    reader = (spark.readStream if streaming else spark.read).format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if streaming and max_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", max_per_batch)
    return reader.load(path)

"""Seeded generators of test messages, and the rates of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORKERS = 10
ROUND_SIZE = 100_000  # ids restart after this many messages of a worker
PAYLOAD_BYTES = 1024


def padded_payload(number: Column, size: int = PAYLOAD_BYTES) -> Column:
    """JSON ``{"data","id","message"}`` whose data field pads the text to ``size`` bytes."""
    message = F.concat(F.lit("Message "), number.cast("string"))

    def text(data: Column) -> Column:
        return F.to_json(
            F.struct(data.alias("data"), number.alias("id"), message.alias("message"))
        )

    filler = F.repeat(F.lit("A"), F.lit(size) - F.octet_length(text(F.lit(""))))
    return text(filler)


def round_id(counter: Column, round_size: int = ROUND_SIZE) -> Column:
    return F.pmod(counter, F.lit(round_size))


def worker_messages(
    spark: SparkSession, per_worker: int, workers: int = WORKERS, size: int = PAYLOAD_BYTES
) -> DataFrame:
    """``per_worker`` padded messages from each worker, one task per worker."""
    ids = spark.range(0, workers * per_worker, 1, workers)
    return ids.select(
        F.call_function("div", F.col("id"), F.lit(per_worker)).cast("int").alias("worker"),
        padded_payload(round_id(F.pmod("id", F.lit(per_worker))), size).alias("value"),
    )


def sample_events(spark: SparkSession, rows: int, keys: int = 10, seed: int = 42) -> DataFrame:
    """``id`` and a message ``{"name","size","count"}`` with ``keys`` distinct counts."""

    def pick(column: int, n: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(column)), F.lit(n))

    def choose(column: int, words: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), (pick(column, len(words)) + 1).cast("int"))

    fields = F.struct(
        choose(0, ["A", "B", "C", "D"]).alias("name"),
        choose(1, ["small", "medium", "large"]).alias("size"),
        pick(2, keys).alias("count"),
    )
    return spark.range(rows).select("id", F.to_json(fields).alias("value"))


def kafka_records(df: DataFrame, topic: str, partition: str = "worker") -> DataFrame:
    """The columns the Kafka sink takes: empty key, explicit partition."""
    return df.select(
        F.lit(topic).alias("topic"),
        F.lit("").alias("key"),
        F.col("value").cast("string").alias("value"),
        F.col(partition).cast("int").alias("partition"),
    )


def send_to_kafka(df: DataFrame, servers: str, topic: str, partition: str = "worker") -> None:
    """Write messages to their partitions of a topic (needs the Kafka connector)."""
    records = kafka_records(df, topic, partition)
    records.write.format("kafka").option("kafka.bootstrap.servers", servers).save()


def throughput(df: DataFrame, ts: str, *keys: str) -> DataFrame:
    """Messages and their rate per second between the first and the last, by ``keys``.

    The rate is null where all messages have one time.
    """
    span = F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))
    counts = df.groupBy(*keys).agg(F.count("*").alias("messages"), span.alias("micros"))
    rate = F.col("messages").cast("double") * 1000000 / F.nullif(F.col("micros"), F.lit(0))
    return counts.withColumn("per_second", rate)

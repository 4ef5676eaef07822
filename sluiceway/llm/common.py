"""Helpers the training-data operators share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
# ASCII letters only: every other byte of a UTF-8 text stays as it is.
SPACES = r"[\x20\x09-\x0D]+"


def record(**fields: T.DataType) -> T.StructType:
    """A struct type from names and types, usable before a session exists."""
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Settings that the Python functions of this package rely on.

    Arrow batches hold few rows and bytes, so that long texts fit a Python worker. Workers
    look for this package where the driver has it; on a cluster it is installed or given
    with ``--py-files``.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def held_out(key: str, parts: int, remainder: int) -> Column:
    """Rows no model learns from. Rows without a key count as held out."""
    return F.coalesce(fold(key, parts) == remainder, F.lit(True))


class Remembered(dict):
    """What a function gave for strings or bytes, up to about ``most`` bytes; then it starts
    anew, also in the middle of a text."""

    # What an entry takes besides the bytes of its key and value.
    ENTRY = 200

    def __init__(self, found: Callable, most: int):
        super().__init__()
        self.found, self.most, self.size = found, most, 0

    def __missing__(self, key):
        value = self.found(key)
        size = self.ENTRY + len(key) + (len(value) if isinstance(value, bytes) else 0)
        if self.size + size > self.most:
            self.clear()
        self[key] = value
        self.size += size
        return value

    def clear(self) -> None:
        super().clear()
        self.size = 0


@contextmanager
def forgotten(*remembered: Remembered) -> Iterator[None]:
    """Empty these on leaving: Python workers live on from one task to the next."""
    try:
        yield
    finally:
        for one in remembered:
            one.clear()


def ascii_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased, as UTF-8 bytes."""
    # bytes.lower and bytes.split know ASCII only: 0x09-0x0D and 0x20 separate words.
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def of_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Just the two columns an operator reads, so that no other column can clash."""
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

"""The first n valid messages without reading what lies behind them.

Messages lie in segments, read in order: offsets of a table or a topic, or files. Each step
reads some more segments, decodes them once and counts what is valid; what was found says
how many segments the next step needs.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.operators.decode import accepted
from sluiceway.session import stored
from sluiceway.sources.messages import FILE_FORMATS, kafka_options

MARGIN = 1.1  # more segments than the share of valid messages so far asks for


@dataclass(frozen=True)
class Segments:
    """``read(start, stop)`` gives the messages of segments start to stop - 1, up to ``end``.

    Segments must follow each other in the order of the messages.
    """

    read: Callable[[int, int], DataFrame]
    start: int
    end: int


def offset_segments(df: DataFrame, offset: str, end: int | None = None) -> Segments:
    """The rows of a table by a BIGINT offset; rows without one are left out.

    The bounds come from the one column, unless the end is known. Ranges reach the scan as
    filters, so row groups beyond a range are skipped.
    """
    if not isinstance(df.schema[offset].dataType, (T.LongType, T.IntegerType)):
        raise ValueError(f"Column {offset} must be a whole number")
    low, high = df.agg(F.min(offset), F.max(offset)).first() if end is None else (0, end - 1)

    def read(start: int, stop: int) -> DataFrame:
        return df.where((F.col(offset) >= start) & (F.col(offset) < stop))

    return Segments(read, low or 0, 0 if high is None else high + 1)


def file_segments(
    spark: SparkSession, files: list[str], fmt: str = "text", schema: T.StructType | str | None = None
) -> Segments:
    """One segment per file, in the order given; files behind the last step are not opened."""
    if fmt not in FILE_FORMATS:
        raise ValueError(f"fmt must be one of {FILE_FORMATS}, not {fmt!r}")
    if fmt == "parquet" and schema is None:
        raise ValueError("segments of parquet files need a schema")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)

    def read(start: int, stop: int) -> DataFrame:
        return reader.load(files[start:stop])

    return Segments(read, 0, len(files))


def kafka_range(
    servers: str, topic: str, partition: int, start: int, stop: int
) -> dict[str, str]:
    """Options that read offsets start to stop - 1 of one partition of a topic."""
    options = kafka_options(servers, topic)
    del options["subscribe"]
    return options | {
        "assign": json.dumps({topic: [partition]}),
        "startingOffsets": json.dumps({topic: {str(partition): start}}),
        "endingOffsets": json.dumps({topic: {str(partition): stop}}),
    }


def kafka_segments(
    spark: SparkSession, servers: str, topic: str, partition: int, start: int, end: int
) -> Segments:
    """The offsets of one partition (needs the Kafka connector)."""

    def read(start: int, stop: int) -> DataFrame:
        options = kafka_range(servers, topic, partition, start, stop)
        return spark.read.format("kafka").options(**options).load()

    return Segments(read, start, end)


def next_step(step: int, seen: int, found: int, wanted: int) -> int:
    """Segments to read next, given those seen, what they had, and what is still wanted.

    At most twice as many as before, so that few valid messages at first do not lead to
    reading everything.
    """
    if not found:
        return 2 * step
    needed = int(MARGIN * wanted * seen / found) + 1
    return max(1, min(2 * step, needed))


def first_n_in_steps(
    segments: Segments,
    n: int,
    order_by: list[str],
    parse: Callable[[DataFrame], DataFrame],
    first_step: int = 1,
) -> DataFrame:
    """The first ``n`` valid rows of the segments; fewer if there are not as many.

    ``parse`` decodes messages and keeps ``reason``; ``order_by`` orders the rows of a step
    totally. Each step is decoded once and stored. No segments give no rows.
    """
    if n < 0 or first_step < 1:
        raise ValueError("n must not be negative, and a step has a segment at least")
    found: list[DataFrame] = []
    have, at, step = 0, segments.start, first_step
    while have < n and at < segments.end:
        stop = min(segments.end, at + step)
        rows = stored(accepted(parse(segments.read(at, stop))), "prefix")
        count = rows.count()
        found.append(rows if have + count <= n else rows.orderBy(*order_by).limit(n - have))
        have, at = have + count, stop
        step = next_step(step, at - segments.start, have, n - have)
    if not found:
        return accepted(parse(segments.read(segments.start, segments.start))).limit(0)
    return reduce(DataFrame.unionAll, found)

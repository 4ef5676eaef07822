"""Change data of a stream in timestamp order, whatever order it arrives in."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from sluiceway.operators.split import split_in_order
from sluiceway.operators.windows import DEFAULT_DURATION
from sluiceway.schema import partition_key
from sluiceway.session import stored, temporary_tables
from sluiceway.sinks.tables import batch_path
from sluiceway.streaming.state import timed_state
from sluiceway.streaming.windows import for_each_window

SALTS = 8
# A delay is this many spans of time, none shorter than the least.
SPANS = 32
LEAST_SPAN = timedelta(minutes=1)
PACKED_ROWS = 4096
PACKED_BYTES = 4 << 20
# Columns that go beside those of the stream.
AT, TIME, STATE = "_at_micros", "_event_time", "_state_key"
PACKED = T.StructType([T.StructField("packed", T.BinaryType())])
HELD = "first BIGINT, last BIGINT, packed BINARY"


def _pack(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _unpack(packed: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(packed).read_next_batch()


def _entry(rows: pa.RecordBatch) -> tuple[int, int, bytes]:
    """Packed rows with their first and last time."""
    ends = pc.min_max(rows.column(AT))
    return ends["min"].as_py(), ends["max"].as_py(), _pack(rows)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed in batch.column(0):
            yield _unpack(packed.as_buffer())


class _Buffer(StatefulProcessor):
    """Holds the rows of a span, packed, until no earlier one can come any more."""

    def __init__(self, schema: T.StructType):
        self.schema = to_arrow_schema(schema)

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", HELD)
        self.awaited = handle.getValueState("awaited", "ms BIGINT")

    def _await(self, earliest: int) -> None:
        """One timer, for the earliest row."""
        first = -(-earliest // 1000)
        before = self.awaited.get()
        if before is not None:
            if before[0] <= first:
                return
            self.handle.deleteTimer(before[0])
        self.awaited.update((first,))
        self.handle.registerTimer(first)

    def _entries(self, rows: Iterator[Row]) -> Iterator[tuple[int, int, bytes]]:
        while part := list(islice(rows, PACKED_ROWS)):
            arrays = [pa.array(column, f.type) for column, f in zip(zip(*part), self.schema)]
            batch = pa.RecordBatch.from_arrays(arrays, schema=self.schema)
            step = max(1, len(part) * PACKED_BYTES // max(batch.nbytes, 1))
            for at in range(0, len(part), step):
                yield _entry(batch.slice(at, step))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        earliest = []
        for entry in self._entries(rows):
            self.held.appendValue(entry)
            earliest.append(entry[0])
        self._await(min(earliest))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        left = []
        make = Row(*PACKED.names)
        for first, last, packed in self.held.get():
            if last <= upto:
                yield make(bytes(packed))
            elif first > upto:
                left.append((first, last, bytes(packed)))
            else:
                rows = _unpack(packed)
                due = pc.less_equal(rows.column(AT), upto)
                yield make(_pack(rows.filter(due)))
                left.append(_entry(rows.filter(pc.invert(due))))
        self.held.clear()
        self.awaited.clear()
        for entry in left:
            self.held.appendValue(entry)
        if left:
            self._await(min(entry[0] for entry in left))


def _span(delay: str) -> Column:
    """Microseconds of a span."""
    whole = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.lit(delay).cast("interval"))
    least = LEAST_SPAN // timedelta(microseconds=1)
    return F.greatest(F.call_function("div", whole, F.lit(SPANS)), F.lit(least).cast("bigint"))


def released(
    stream: DataFrame, key: str, ts: str, delay: str = "10 seconds", salts: int = SALTS
) -> DataFrame:
    """The changes of a stream, each given once the watermark has reached its time.

    So every change of a micro-batch is at or before the watermark, and every one of the
    next micro-batches behind it. Rows of a span of time are held packed, many to an entry,
    under up to ``salts`` state keys, whatever their own keys: state keys and timers grow with
    the time that is held, not with rows or keys, no busy span or key is one task, and a
    micro-batch opens only spans that the watermark has reached. The state holds what is not
    ``delay`` old. Changes without a key or time are left out, later ones are dropped and
    counted in the progress of the query.
    """
    schema = T.StructType([T.StructField(AT, T.LongType()), *stream.schema.fields])
    for name in (AT, TIME, STATE):
        if name in stream.columns:
            raise ValueError(f"Column {name} already exists")
    partition_key(stream, key)
    timed = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    time = F.col(ts).cast("timestamp")
    at = F.unix_micros(time)
    length = _span(delay)
    span = F.call_function("div", at - F.pmod(at, length), length)
    salt = F.pmod(F.xxhash64(*stream.columns), F.lit(salts))
    rows = timed.select(
        at.alias(AT), *stream.columns, time.alias(TIME), (span * salts + salt).alias(STATE)
    )
    grouped = rows.withWatermark(TIME, delay).groupBy(STATE)
    out = grouped.transformWithState(_Buffer(schema), PACKED, "append", "eventTime")
    return out.mapInArrow(_unpacked, schema).drop(AT)


def follow_in_order(
    stream: DataFrame,
    key: str,
    ts: str,
    seq: str,
    path: str,
    checkpoint: str,
    delay: str = "10 seconds",
    salts: int = SALTS,
    every: timedelta = DEFAULT_DURATION,
    available_now: bool = False,
) -> StreamingQuery:
    """Write the changes of a stream so that each key's stand in order of ``ts`` and ``seq``.

    Each micro-batch is range-partitioned into a directory of its own: its files, by name,
    and the directories, by number, hold the order, at any skew of the keys. It is the order
    of :func:`~sluiceway.operators.cdc.cdc_order` over all changes that were not too late.
    """

    def handle(df: DataFrame, batch_id: int) -> None:
        with temporary_tables(df.sparkSession):
            # Stored, because the ranges are sampled first, which would run the state twice.
            rows = split_in_order(stored(df, "released"), key, (ts, seq))
            rows.write.mode("overwrite").parquet(batch_path(path, batch_id))

    with timed_state(stream.sparkSession):
        return for_each_window(released(stream, key, ts, delay, salts), handle, checkpoint, every, available_now)

"""The whole step for one batch: decode, project, split by key, write, report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.operators.decode import (
    BAD_JSON,
    BAD_PAYLOAD,
    REASON,
    TOO_LARGE,
    accepted,
    decode,
    rejected,
)
from sluiceway.operators.project import MISSING_REQUIRED, NULL_REQUIRED, project
from sluiceway.operators.windows import WindowSpec, arrival_windows, count_windows
from sluiceway.schema import message_schema
from sluiceway.session import stored, temporary_tables
from sluiceway.sinks.tables import (
    BATCH,
    MAX_ATTEMPTS,
    RETRY_DELAY,
    WriteFailed,
    batch_path,
    ensure_table,
    overwrite_batch,
    window_files,
    with_retries,
    write_batch,
    written_files,
)

_RAW = "_raw"
WINDOW, COUNT_WINDOW = "window_no", "batch_no"
REASONS = (BAD_PAYLOAD, BAD_JSON, TOO_LARGE, MISSING_REQUIRED, NULL_REQUIRED)


@dataclass(frozen=True)
class IngestResult:
    batch_id: int
    attempt: int
    valid: int
    null_keys: int
    rejected: dict[str, int]
    target: str | None = field(default=None, compare=False)
    key: str | None = field(default=None, compare=False)
    first_window: int | None = field(default=None, compare=False)
    last_window: int | None = field(default=None, compare=False)

    @property
    def written(self) -> int:
        return self.valid - self.null_keys

    @property
    def window_id(self) -> str:
        """The arrival window that a micro-batch forms, or the first of those it has."""
        first = self.batch_id + 1 if self.first_window is None else self.first_window
        return f"window-{first}"

    def files(self, spark: SparkSession) -> DataFrame:
        """The files of this batch: path, key, rows."""
        if self.target is None or not self.written:
            return spark.createDataFrame([], f"path STRING, `{self.key}` BIGINT, rows BIGINT")
        return written_files(spark.read.parquet(self.target), self.key)

    def window_files(self, spark: SparkSession) -> DataFrame:
        """Where the count windows of this batch lie: batch_no, key, path, rows."""
        if self.target is None or not self.written:
            columns = f"{COUNT_WINDOW} BIGINT, `{self.key}` BIGINT, path STRING, rows BIGINT"
            return spark.createDataFrame([], columns)
        return window_files(spark.read.parquet(self.target), COUNT_WINDOW, self.key)


def typed_messages(
    messages: DataFrame,
    schema: T.StructType | str,
    value: str = "value",
    keep: tuple[str, ...] = (),
    int32_overflow: str = "null",
) -> DataFrame:
    """Decoded and typed rows with their ``reason``, valid or not."""
    return project(decode(messages, value), schema, keep, int32_overflow)


def ingest_batch(
    messages: DataFrame,
    schema: T.StructType | str,
    key: str,
    path: str | None = None,
    batch_id: int = 0,
    dead_letters: str | None = None,
    value: str = "value",
    int32_overflow: str = "null",
    window: WindowSpec | None = None,
    ts: str = "timestamp",
    salt: int = 1,
    max_attempts: int = MAX_ATTEMPTS,
    delay: float = RETRY_DELAY,
    table: str | None = None,
    table_format: str = "parquet",
    count_size: int | None = None,
    order_by: tuple[str, ...] = (),
    start: int = 0,
) -> IngestResult:
    """Write the valid rows of a batch below ``path`` or into ``table``, split by key.

    The source is read and parsed once: typed rows and the raw values of rejected ones are
    stored, and counts, rows and dead letters come from there, so that a batch of which no
    row can be written ends like any other. Running a batch again overwrites it.

    With ``window`` the rows lie in a directory per arrival window, by the time in ``ts``;
    with ``count_size`` every ``count_size`` valid messages form a window, in the order of the
    columns ``order_by`` of the messages and after ``start`` messages of earlier batches. These
    windows are many and small, so they get no directories: ``batch_no`` is a column by which
    the files of a key are sorted, and a read of one window skips by its bounds in them.
    """
    if (path is None) == (table is None):
        raise ValueError("give either a path or a table")
    if count_size is not None and (window is not None or table is not None or not order_by):
        raise ValueError("count windows need order_by and a path, and no arrival window")
    schema = message_schema(schema)
    if count_size is not None and COUNT_WINDOW in schema.names:
        raise ValueError(f"a message with count windows has no field {COUNT_WINDOW}")
    spark = messages.sparkSession
    outer: tuple[str, ...] = ()
    if window is not None:
        messages, outer = arrival_windows(messages, ts, window), (WINDOW,)
    carried = tuple(f"_order_{n}" for n in range(len(order_by))) if count_size else ()
    # Renamed, because the message may have fields of these names.
    raw = messages.select(
        F.col(value).alias(_RAW),
        *outer,
        *[F.col(c).alias(name) for c, name in zip(order_by, carried, strict=False)],
    )
    with temporary_tables(spark):
        typed = typed_messages(raw, schema, _RAW, (_RAW, *outer, *carried), int32_overflow)
        refused = F.when(F.col(REASON).isNotNull(), F.col(_RAW)).alias(_RAW)
        kept = stored(typed.select(*outer, *carried, *schema.names, REASON, refused), "ingest")
        counts = _counts(kept, key, outer)
        rows = accepted(kept).select(*outer, *carried, *schema.names)
        if count_size:
            rows = count_windows(rows, count_size, list(carried), start)
        inner = (COUNT_WINDOW,) if count_size else ()
        rows = rows.select(*outer, *inner, *schema.names)
        attempt, done = _put(
            rows, path, table, batch_id, key, outer, inner, salt, max_attempts, delay, schema, table_format
        )
        if not done:
            raise WriteFailed(f"batch {batch_id} failed in {max_attempts} attempts")
        by_reason = {reason: counts[reason] for reason in REASONS if counts[reason]}
        if dead_letters and by_reason:
            letters = rejected(kept).select(F.col(_RAW).alias("value"), REASON)
            letters.write.mode("overwrite").parquet(batch_path(dead_letters, batch_id))
    first, last = counts["first"], counts["last"]
    if count_size and counts["valid"]:
        first, last = start // count_size, (start + counts["valid"] - 1) // count_size
    target = None if path is None else batch_path(path, batch_id)
    return IngestResult(
        batch_id, attempt, counts["valid"], counts["null_keys"], by_reason, target, key, first, last
    )


def _counts(kept: DataFrame, key: str, outer: tuple[str, ...]) -> dict[str, int]:
    """Valid rows, those without a key, and rejected ones by reason, of what was stored."""
    reason = F.col(REASON)
    window = F.when(reason.isNull(), F.col(outer[0])) if outer else F.lit(None).cast("bigint")
    row = kept.agg(
        F.count_if(reason.isNull()).alias("valid"),
        F.count_if(reason.isNull() & F.col(key).isNull()).alias("null_keys"),
        *[F.count_if(reason == name).alias(name) for name in REASONS],
        F.min(window).alias("first"),
        F.max(window).alias("last"),
    ).first()
    return row.asDict()


def _put(
    rows: DataFrame,
    path: str | None,
    table: str | None,
    batch_id: int,
    key: str,
    outer: tuple[str, ...],
    inner: tuple[str, ...],
    salt: int,
    max_attempts: int,
    delay: float,
    schema: T.StructType,
    table_format: str,
) -> tuple[int, bool]:
    if path is not None:
        return write_batch(
            rows, path, batch_id, key, max_attempts, delay, inner, salt, outer
        )
    columns = [T.StructField(name, T.LongType()) for name in outer]
    whole = T.StructType([*columns, *schema.fields, T.StructField(BATCH, T.LongType())])
    ensure_table(rows.sparkSession, table, whole, key, fmt=table_format, outer=(BATCH,))
    attempt, error = with_retries(
        lambda: overwrite_batch(rows, table, batch_id, key, table_format, salt),
        max_attempts,
        delay,
    )
    return attempt, error is None

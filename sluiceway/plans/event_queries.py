"""Queries over the ``events`` table for sessions, panes, histories and running streams.

Each has the SQL that checks it. Streams read copies of the events, which arrive in parts: a
stream takes up one part as a micro-batch, ends, and goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluiceway.operators import cdc, decode, distinct, panes, prefix, sessions
from sluiceway.operators.windows import WindowSpec
from sluiceway.plans.sample_messages import event_messages
from sluiceway.session import scratch_path
from sluiceway.sinks import bucketed
from sluiceway.streaming import firings, late, ordered, rotation
from sluiceway.streaming.prefix import follow_first_n
from sluiceway.streaming.state import timed_state

Query = Callable[[SparkSession, str], DataFrame]

GAP = timedelta(minutes=30)
DAY = timedelta(days=1)
ORIGIN = datetime(2024, 1, 1)
SIX_HOURS = WindowSpec(timedelta(hours=6), ORIGIN)
FIRST_N = 1000
BUCKETS = 16
MONTHS = timedelta(days=90)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _hot(rows: DataFrame) -> DataFrame:
    """A third of all rows under one user."""
    user = F.when(F.col("event_id") % 3 == 0, F.lit(7).cast("bigint")).otherwise(F.col("user_id"))
    return rows.withColumn("user_id", user)


def _in_parts(
    rows: DataFrame, part: Column, count: int, follow: Callable[[DataFrame], StreamingQuery | None]
) -> None:
    """Let the parts arrive one after the other; ``follow`` starts a query that takes up what
    is there and ends."""
    spark = rows.sparkSession
    path = scratch_path(spark, "arrivals")
    for number in range(count):
        rows.where(part == number).write.mode("append").parquet(path)
        query = follow(spark.readStream.schema(rows.schema).parquet(path))
        if query is not None:
            query.awaitTermination()


def _plain(*names: str) -> list[Column]:
    """Times without a zone, as the table has them."""
    return [F.col(name).cast("timestamp_ntz").alias(name) for name in names]


# Prefix reads


def _parse(messages: DataFrame) -> DataFrame:
    return decode.decode(messages).select("event_id", "value", decode.REASON)


def first_n_valid_in_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = prefix.offset_segments(event_messages(events(spark, sf_dir)), "event_id")
    found = prefix.first_n_in_steps(segments, FIRST_N, ["event_id"], _parse, first_step=256)
    return found.drop(decode.REASON)


def stream_first_n_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of 400 messages; the stream ends itself in the third."""
    messages = event_messages(events(spark, sf_dir))
    path, checkpoint = scratch_path(spark, "prefix"), scratch_path(spark, "checkpoint")
    part = F.least(F.call_function("div", F.col("event_id"), F.lit(400)), F.lit(3))

    def follow(stream: DataFrame) -> StreamingQuery | None:
        return follow_first_n(
            stream, path, FIRST_N, ["event_id"], checkpoint, _parse, available_now=True
        )

    _in_parts(messages, part, 4, follow)
    return spark.read.parquet(f"{path}/rows").select("event_id", "value")


# Windows


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessions(events(spark, sf_dir), "ts", "user_id", GAP)


def session_windows_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessions(_hot(events(spark, sf_dir)), "ts", "user_id", GAP)


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = {"users": ("sum", "user_id"), "low": ("min", "value"), "high": ("max", "value")}
    return panes.sliding(
        events(spark, sf_dir), "ts", timedelta(hours=6), timedelta(hours=1), measures, ("event_type",)
    )


def stream_windows_with_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with and without rows, closed by the watermark; two parts, split by time."""
    rows = events(spark, sf_dir).select("event_id", "ts")
    path, checkpoint = scratch_path(spark, "rotation"), scratch_path(spark, "checkpoint")
    part = F.when(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"), 0).otherwise(1)

    def follow(stream: DataFrame) -> StreamingQuery:
        return rotation.follow_windows_with_empty(
            stream, "ts", SIX_HOURS, path, checkpoint, available_now=True
        )

    _in_parts(rows, part, 2, follow)
    return spark.read.parquet(path).select(
        "window_no", "window_id", "rows", *_plain("window_start", "window_end")
    )


def stream_open_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open window as the state of a stream has it."""
    batch = F.call_function("div", F.col("event_id"), F.lit(100)).alias("batch_id")
    rows = events(spark, sf_dir).select("ts", batch)
    checkpoint = scratch_path(spark, "checkpoint")

    def follow(stream: DataFrame) -> StreamingQuery:
        counts = rotation.window_batch_counts(stream, "ts", "batch_id", SIX_HOURS)
        writer = counts.writeStream.format("noop").option("checkpointLocation", checkpoint)
        return writer.outputMode("append").trigger(availableNow=True).start()

    _in_parts(rows, F.pmod(F.col("batch_id"), F.lit(2)), 2, follow)
    return rotation.open_window(spark, checkpoint, SIX_HOURS)


def stream_firings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What early, on-time and late firings with retractions add up to for each day and type.

    The second part brings rows of every day, all of them late by then; none is too late.
    """
    rows = events(spark, sf_dir).select("event_id", "ts", "event_type", "user_id")
    path, checkpoint = scratch_path(spark, "firings"), scratch_path(spark, "checkpoint")

    def follow(stream: DataFrame) -> StreamingQuery:
        fired = firings.firings(
            stream, "ts", "event_type", "user_id", DAY, lateness=MONTHS, mode=firings.RETRACTING
        )
        writer = fired.writeStream.format("parquet").option("path", path)
        writer = writer.option("checkpointLocation", checkpoint).outputMode("append")
        with timed_state(spark):
            return writer.trigger(availableNow=True).start()

    _in_parts(rows, F.pmod(F.col("event_id"), F.lit(2)), 2, follow)
    found = spark.read.parquet(path).groupBy("event_type", "window_start").agg(
        F.sum("rows").alias("rows"),
        F.sum("total").alias("users"),
        F.count_if(F.col("pane") == firings.ON_TIME).alias("on_time"),
    )
    return found.select("event_type", *_plain("window_start"), "rows", "users", "on_time")


def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows were late: three parts, each over the whole time."""
    rows = events(spark, sf_dir).select("event_id", "ts")
    path, checkpoint = scratch_path(spark, "late"), scratch_path(spark, "checkpoint")

    def follow(stream: DataFrame) -> StreamingQuery:
        return late.follow_with_late(stream, "ts", path, checkpoint, timedelta(days=3), available_now=True)

    _in_parts(rows, F.pmod(F.col("event_id"), F.lit(3)), 3, follow)
    both = [
        kind(spark, path, rows.schema).select("event_id", "batch_id", F.lit(name).alias("kind"))
        for kind, name in ((late.on_time_rows, "on_time"), (late.late_rows, "late"))
    ]
    return both[0].unionAll(both[1])


# Change data, distinct counts, layouts


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type")


def cdc_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.cdc_history(_changes(spark, sf_dir), "user_id", "ts", "event_id")


def cdc_history_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.cdc_history(_hot(_changes(spark, sf_dir)), "user_id", "ts", "event_id")


def stream_changes_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that arrive in two interleaved parts, with the number their order gives them.

    A micro-batch's directory, then time and ``event_id`` inside it, is the order they stand in.
    """
    rows = _changes(spark, sf_dir)
    path, checkpoint = scratch_path(spark, "ordered"), scratch_path(spark, "checkpoint")

    def follow(stream: DataFrame) -> StreamingQuery:
        return ordered.follow_in_order(
            stream, "user_id", "ts", "event_id", path, checkpoint, delay="20 days", available_now=True
        )

    _in_parts(rows, F.pmod(F.col("event_id"), F.lit(2)), 2, follow)
    written = spark.read.parquet(path)
    return cdc.with_ordinal(written, ["batch_id", "ts", "event_id"], ["user_id"], "change_no").drop("batch_id")


def distinct_users_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users of each day, merged from bitmaps of a quarter of a minute."""
    fine = distinct.window_bitmaps(events(spark, sf_dir), "ts", "user_id")
    return distinct.distinct_counts(distinct.merge_bitmaps(fine, DAY))


def bucketed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch in a bucketed table, made twice: rows of each key."""
    rows = events(spark, sf_dir).select("user_id", "event_id")
    table = "sluiceway_bucketed_events"
    location = scratch_path(spark, "bucketed")
    bucketed.ensure_bucketed_table(spark, table, rows.schema, "user_id", BUCKETS, "replace", location)
    for _ in range(2):
        bucketed.overwrite_bucketed_batch(rows, table, 1, "user_id")
    files = F.count_distinct(F.col("_metadata.file_path"))
    return spark.table(table).groupBy("user_id").agg(
        F.count("*").alias("rows"), files.alias("files"), F.max("batch_id").alias("batch_id")
    )


def queries() -> dict[str, Query]:
    return {
        "first_n_valid_in_steps": first_n_valid_in_steps,
        "stream_first_n_valid": stream_first_n_valid,
        "session_windows": session_windows,
        "session_windows_hot": session_windows_hot,
        "sliding_windows": sliding_windows,
        "stream_windows_with_empty": stream_windows_with_empty,
        "stream_open_window": stream_open_window,
        "stream_firings": stream_firings,
        "stream_late_rows": stream_late_rows,
        "cdc_history": cdc_history,
        "cdc_history_hot": cdc_history_hot,
        "stream_changes_in_order": stream_changes_in_order,
        "distinct_users_daily": distinct_users_daily,
        "bucketed_batch": bucketed_batch,
    }


def oracle_sql() -> dict[str, str]:
    hot = "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id) FROM events"
    session = """
        SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end,
            count(*) AS rows
        FROM (SELECT *, sum(apart) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number
            FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (
                    PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE
                    THEN 0 ELSE 1 END AS apart
                FROM ({}) WHERE user_id IS NOT NULL AND ts IS NOT NULL))
        GROUP BY user_id, number"""
    history = """
        SELECT event_id, ts, user_id, event_type,
            lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to
        FROM ({}) WHERE user_id IS NOT NULL"""
    numbers = """
        WITH numbered AS (
            SELECT event_id, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) // 21600000000 + 1
                AS window_no FROM events)"""
    window = """'window-' || window_no AS window_id,
            TIMESTAMP '2024-01-01' + (window_no - 1) * INTERVAL 6 HOUR AS window_start,
            TIMESTAMP '2024-01-01' + window_no * INTERVAL 6 HOUR AS window_end"""
    return {
        "session_windows": session.format("SELECT * FROM events"),
        "session_windows_hot": session.format(hot),
        "sliding_windows": """
            SELECT s AS window_start, s + INTERVAL 6 HOUR AS window_end, event_type, count(*) AS rows,
                CAST(sum(user_id) AS BIGINT) AS users, min(value) AS low, max(value) AS high
            FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) - unnest(range(6)) * INTERVAL 1 HOUR AS s
                FROM events)
            GROUP BY ALL""",
        "stream_windows_with_empty": numbers
        + f""", counts AS (SELECT window_no, count(*) AS n FROM numbered GROUP BY window_no
            ), spine AS (
                SELECT unnest(generate_series((SELECT min(window_no) FROM numbered),
                    (SELECT max(window_no) FROM numbered))) AS window_no
            ), described AS (
                SELECT window_no, {window}, coalesce(n, 0) AS rows
                FROM spine LEFT JOIN counts USING (window_no))
            SELECT * FROM described
            WHERE window_end <= (SELECT max(ts) - INTERVAL 10 SECOND FROM events)""",
        "stream_open_window": numbers
        + """SELECT 'window-' || window_no AS window_id, count(DISTINCT event_id // 100) AS batches,
                count(*) AS rows
            FROM numbered GROUP BY window_no ORDER BY window_no DESC LIMIT 1""",
        # The first part fires each day it has on time, but for the last one, which is open.
        "stream_firings": """
            SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS rows,
                CAST(sum(user_id) AS BIGINT) AS users,
                CASE WHEN count(*) FILTER (event_id % 2 = 0) > 0
                    AND time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY
                        <= (SELECT max(ts) - INTERVAL 10 SECOND FROM events WHERE event_id % 2 = 0)
                    THEN 2 ELSE 0 END AS on_time
            FROM events GROUP BY event_type, time_bucket(INTERVAL 1 DAY, ts)""",
        "stream_late_rows": """
            WITH last AS (
                SELECT p.batch_id, max(ts) - INTERVAL 3 DAY AS mark
                FROM (SELECT unnest([1, 2]) AS batch_id) p JOIN events ON event_id % 3 < p.batch_id
                GROUP BY p.batch_id)
            SELECT event_id, event_id % 3 AS batch_id,
                CASE WHEN ts IS NULL OR coalesce(ts < mark, false) THEN 'late' ELSE 'on_time' END AS kind
            FROM events LEFT JOIN last ON last.batch_id = event_id % 3""",
        "cdc_history": history.format("SELECT * FROM events"),
        "cdc_history_hot": history.format(hot),
        # The second part is behind the watermark of the first where that is 20 days old.
        "stream_changes_in_order": """
            WITH first AS (
                SELECT time_bucket(INTERVAL 1 MILLISECOND, max(ts)) - INTERVAL 20 DAY AS mark
                FROM events WHERE event_id % 2 = 0
            ), latest AS (
                SELECT time_bucket(INTERVAL 1 MILLISECOND, max(ts)) - INTERVAL 20 DAY AS mark FROM events
            ), taken AS (
                SELECT event_id, ts, user_id, event_type FROM events
                WHERE user_id IS NOT NULL AND (event_id % 2 = 0 OR ts > (SELECT mark FROM first))
                    AND ts <= (SELECT mark FROM latest))
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS change_no
            FROM taken""",
        "distinct_users_daily": """
            SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start,
                count(DISTINCT user_id) AS distinct_values
            FROM events GROUP BY ALL""",
        "bucketed_batch": """
            SELECT user_id, count(*) AS rows, CAST(1 AS BIGINT) AS files, CAST(1 AS BIGINT) AS batch_id
            FROM events WHERE user_id IS NOT NULL GROUP BY user_id""",
    }

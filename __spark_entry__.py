
from __future__ import annotations

import os
import sys
from collections.abc import Callable
from datetime import timedelta

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.operators import cdc, decode, project, split, windows
from sluiceway.plans import event_queries
from sluiceway.plans.ingest import ingest_batch, typed_messages
from sluiceway.plans.sample_messages import CODE, MESSAGE, SCALARS, event_messages, scalar_messages
from sluiceway.schema import message_schema
from sluiceway.session import scratch_path
from sluiceway.sinks import tables
from sluiceway.sources import generate

try:
    import corpus_pipeline
    from sluiceway.llm import queries as training_data
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "sluiceway.llm"):
        raise
    corpus_pipeline = training_data = None

FIFTEEN_SECONDS = windows.WindowSpec(timedelta(seconds=15))
SIX_HOURS = windows.WindowSpec(timedelta(hours=6))
COUNT_SIZE = 1000
FIRST_N = 1000


def entry(spark: SparkSession) -> DataFrame:
    """Messages to typed rows, split by key: rows per key."""
    return _partition_sizes(spark, "/root/testdata/sf0.001")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.decode(event_messages(_events(spark, sf_dir)))


def _typed(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """The valid rows with their declared fields, after the columns to keep."""
    typed = typed_messages(event_messages(_events(spark, sf_dir)), MESSAGE, keep=keep)
    return decode.accepted(typed).drop(decode.REASON)


# Decoding


def _decode_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.coalesce(decode.REASON, F.lit("valid")).alias("status")
    return _decoded(spark, sf_dir).select("event_id", status)


def _parse_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.accepted(_decoded(spark, sf_dir)).select("event_id", "value")


def _dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.rejected(_decoded(spark, sf_dir)).select("event_id", "value", decode.REASON)


def _error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.error_counts(_decoded(spark, sf_dir))


def _first_n_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _decoded(spark, sf_dir).select("event_id", "value", decode.REASON)
    return decode.first_n_valid(rows, FIRST_N, ["event_id"]).drop(decode.REASON)


# Projection and typing


def _typed_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir, "event_id")


def _typed_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = scalar_messages(_events(spark, sf_dir))
    typed = typed_messages(messages, SCALARS, keep=("event_id",))
    return decode.accepted(typed).drop(decode.REASON)


def _int32_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode.decode(scalar_messages(_events(spark, sf_dir)))
    or_null = project.project(decoded, CODE, ("event_id", decode.DOC))
    both = project.project(
        or_null.withColumnRenamed("code", "or_null"), CODE, ("event_id", "or_null"), "wrap"
    )
    return decode.accepted(both).select("event_id", "or_null", F.col("code").alias("wrapped"))


def _required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "name STRING NOT NULL, size STRING, count BIGINT NOT NULL"
    messages = event_messages(_events(spark, sf_dir))
    typed = typed_messages(messages, schema, keep=("event_id",))
    return typed.select("event_id", decode.REASON)


def _props_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).select("event_id", "props")
    typed = typed_messages(events, "k BIGINT", "props", ("event_id",))
    return decode.accepted(typed).drop(decode.REASON)


# Windows


def _arrival_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).select("event_id", "ts")
    return windows.arrival_windows(events, "ts", FIFTEEN_SECONDS).drop("ts")


def _closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.closed_windows(_events(spark, sf_dir), "ts", SIX_HOURS)


def _batched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = F.call_function("div", F.col("event_id"), F.lit(100))
    return _events(spark, sf_dir).withColumn("batch_id", batch)


def _window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.window_stats(_batched_events(spark, sf_dir), "ts", "batch_id", SIX_HOURS)


def _current_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.current_window(_batched_events(spark, sf_dir), "ts", "batch_id", SIX_HOURS)


def _windows_with_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.windows_with_empty(_events(spark, sf_dir), "ts", FIFTEEN_SECONDS)


def _windows_with_empty_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The origin lies inside the data, so windows before it have numbers below 1."""
    events = _events(spark, sf_dir)
    low, high = (F.unix_micros(end("ts").cast("timestamp")) for end in (F.min, F.max))
    half = F.timestamp_micros(F.call_function("div", low + high, F.lit(2)))
    middle = events.select(half.cast(events.schema["ts"].dataType)).scalar()
    return windows.windows_with_empty(events, "ts", windows.WindowSpec(SIX_HOURS.duration, middle))


def _null_time_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = _events(spark, sf_dir).select(F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts"))
    return windows.null_time_report(timed, "ts")


def _count_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    def parse(messages: DataFrame) -> DataFrame:
        return decode.accepted(decode.decode(messages)).select("event_id", "value")

    return windows.count_windows(_messages(spark, sf_dir), COUNT_SIZE, ["event_id"], then=parse)


def _tumbling_15s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(_events(spark, sf_dir), "ts", timedelta(seconds=15))


def _tumbling_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(_events(spark, sf_dir), "ts", timedelta(hours=6))


def _window_partition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = windows.first_arrival(_events(spark, sf_dir), "ts")
    spec = windows.WindowSpec(SIX_HOURS.duration, start)
    return windows.window_partition_stats(_typed(spark, sf_dir, "ts"), "ts", "count", spec)


# Splitting by key


def _partition_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_by_key(_lineitem(spark, sf_dir), "l_suppkey", ("l_orderkey", "l_linenumber"))


def _partition_split_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_in_order(_events(spark, sf_dir), "user_id", ("ts", "event_id"))


def _null_key_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.null_key_report(_typed(spark, sf_dir), "count")


def _append_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping parts that cover the table, so rows of both appear twice."""
    events = _events(spark, sf_dir)
    failed = F.coalesce(F.col("event_type") == "error", F.lit(False))
    costly = F.coalesce(F.col("value") >= 10, F.lit(False))
    return split.append_batches(events.filter(failed | costly), events.filter(~failed))


def _partition_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.partition_sizes(_typed(spark, sf_dir), "count")


def _partition_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.partition_count(_typed(spark, sf_dir), "count")


def _keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batched_events(spark, sf_dir).select(
        "event_id", "batch_id", (F.col("user_id") % 10).alias("key")
    )


def _partition_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.partition_order(_keyed_events(spark, sf_dir), "key", ["batch_id", "event_id"])


def _partition_order_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above, with a third of all rows under one key and some without one."""
    number = F.col("event_id")
    rows = _batched_events(spark, sf_dir).select(
        "event_id",
        "batch_id",
        F.when(number % 3 == 0, F.lit(7).cast("bigint"))
        .when(number % 11 != 0, F.col("user_id") % 10)
        .alias("key"),
    )
    return split.partition_order(rows, "key", ["batch_id", "event_id"])


# Sinks


def _write_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the typed messages by key to a new directory and open it as a table."""
    path = scratch_path(spark, "typed")
    attempt, ok = tables.write_batch(_typed(spark, sf_dir), path, 0, "count")
    if not ok:
        raise tables.WriteFailed(f"failed after attempt {attempt}")
    return tables.read_batches(spark, path, message_schema(MESSAGE))


def _written_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _write_typed(spark, sf_dir).select("name", "size", "count")


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per key as the files of the write have them."""
    files = tables.written_files(_write_typed(spark, sf_dir), "count")
    return files.groupBy("count").agg(
        F.sum("rows").alias("rows"), (F.count("path") >= 1).alias("has_files")
    )


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_messages(_events(spark, sf_dir))


def _ingested_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole step: rows and dead letters as they are read back."""
    path, letters = scratch_path(spark, "ingested"), scratch_path(spark, "letters")
    ingest_batch(_messages(spark, sf_dir), MESSAGE, "count", path, dead_letters=letters)
    rows = tables.read_batches(spark, path, message_schema(MESSAGE))
    refused = spark.read.schema("value STRING, reason STRING").parquet(letters)
    return rows.select(
        "name", "size", "count", F.lit(None).cast("string").alias("value"), F.lit("valid").alias("status")
    ).unionByName(
        refused.select("value", F.col("reason").alias("status")), allowMissingColumns=True
    )


def _ingested_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch in a catalog table, made twice: the second time changes nothing."""
    name = "sluiceway_ingested"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    for _ in range(2):
        ingest_batch(_messages(spark, sf_dir), MESSAGE, "count", table=name, batch_id=3)
    return spark.table(name).select("name", "size", "count", "batch_id")


def _ingested_count_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every COUNT_SIZE valid messages are a window that is split and written."""
    path = scratch_path(spark, "counted")
    options = {"count_size": COUNT_SIZE, "order_by": ("event_id",)}
    ingest_batch(_messages(spark, sf_dir), MESSAGE, "count", path, **options)
    rows = spark.read.schema("batch_no BIGINT, count BIGINT").parquet(path)
    return rows.groupBy("batch_no", "count").agg(F.count("*").alias("rows"))


# Change data


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as changes of users; some lack their user."""
    user = F.when(F.col("event_id") % 13 != 0, F.col("user_id")).alias("user_id")
    return _events(spark, sf_dir).select("event_id", "ts", user, "event_type", "value")


def _cdc_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.cdc_split(_changes(spark, sf_dir), "user_id", "ts", "event_id")


def _cdc_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.cdc_order(_changes(spark, sf_dir), "user_id", "ts", "event_id")


def _cdc_order_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above, with a third of all changes under one user."""
    user = F.when(F.col("event_id") % 3 == 0, F.lit(7).cast("bigint")).otherwise(F.col("user_id"))
    changes = _changes(spark, sf_dir).withColumn("user_id", user)
    return cdc.cdc_order(changes, "user_id", "ts", "event_id")


def _cdc_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    deleted = F.col("event_type") == "error"
    return cdc.cdc_latest(_changes(spark, sf_dir), "user_id", "ts", "event_id", deleted)


# Generator


def _sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as messages dealt out to ten workers, each counting its own."""
    n = F.col("event_id")
    return _events(spark, sf_dir).select(
        "event_id",
        F.pmod(n, F.lit(generate.WORKERS)).alias("worker"),
        F.call_function("div", n, F.lit(generate.WORKERS)).alias("counter"),
    )


def _padded_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = generate.padded_payload(generate.round_id(F.col("counter")))
    payloads = _sent(spark, sf_dir).select("event_id", "worker", value.alias("value"))
    return payloads.withColumn("bytes", F.octet_length("value"))


def _worker_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages per second of each user, over the time between its first and last one."""
    return generate.throughput(_events(spark, sf_dir), "ts", "user_id")


def _total_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.throughput(_events(spark, sf_dir), "ts")


def _training_data_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    if training_data is None:
        return {}
    return training_data.queries() | {"pipeline": corpus_pipeline.run}


def _training_data_sql() -> dict[str, str]:
    if training_data is None:
        return {}
    whole = corpus_pipeline.ORACLE_SQL
    return training_data.oracle_sql() | ({"pipeline": whole} if whole else {})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator; each takes (spark, sf_dir)."""
    return {
        "decode_status": _decode_status,
        "parse_valid": _parse_valid,
        "dead_letters": _dead_letters,
        "error_counts": _error_counts,
        "first_n_valid": _first_n_valid,
        "typed_projection": _typed_projection,
        "typed_scalars": _typed_scalars,
        "int32_overflow": _int32_overflow,
        "required_fields": _required_fields,
        "props_projection": _props_projection,
        "arrival_window": _arrival_window,
        "closed_windows": _closed_windows,
        "window_stats": _window_stats,
        "windows_with_empty": _windows_with_empty,
        "current_window": _current_window,
        "windows_with_empty_origin": _windows_with_empty_origin,
        "null_time_report": _null_time_report,
        "count_windows": _count_windows,
        "tumbling_15s": _tumbling_15s,
        "tumbling_6h": _tumbling_6h,
        "window_partition_stats": _window_partition_stats,
        "partition_split": _partition_split,
        "partition_split_in_order": _partition_split_in_order,
        "null_key_report": _null_key_report,
        "append_batches": _append_batches,
        "partition_sizes": _partition_sizes,
        "partition_count": _partition_count,
        "partition_order": _partition_order,
        "partition_order_hot": _partition_order_hot,
        "written_partitions": _written_partitions,
        "manifest": _manifest,
        "ingested_partitions": _ingested_partitions,
        "ingested_table": _ingested_table,
        "ingested_count_windows": _ingested_count_windows,
        "cdc_split": _cdc_split,
        "cdc_order": _cdc_order,
        "cdc_order_hot": _cdc_order_hot,
        "cdc_latest": _cdc_latest,
        "padded_payloads": _padded_payloads,
        "worker_throughput": _worker_throughput,
        "total_throughput": _total_throughput,
        **event_queries.queries(),
        **_training_data_queries(),
    }


# The same messages in SQL: raw text, then null for what is not one JSON document.
_MESSAGES = """
WITH parts AS (
    SELECT event_id, ts, CAST(user_id % 10 AS VARCHAR) AS digit,
        '{"name":"' || event_type || '","size":"'
            || CASE WHEN value < 10 THEN 'small' ELSE 'large' END || '"' AS head
    FROM events
), messages AS (
    SELECT event_id, ts, CASE
        WHEN event_id % 97 = 0 THEN '{bad'
        WHEN event_id % 89 = 0 THEN head || ',"count":' || digit || '} trailing'
        WHEN event_id % 83 = 0 THEN head || ',"count":"' || digit || '"}'
        WHEN event_id % 79 = 0 THEN head || ',"count":' || digit || '.5}'
        WHEN event_id % 73 = 0 THEN head || '}'
        WHEN event_id % 71 = 0 THEN head || ',"count":null}'
        ELSE head || ',"count":' || digit || '}' END AS value
    FROM parts
), checked AS (
    SELECT event_id, ts, value, CASE
        WHEN value IS NULL THEN 'bad_payload'
        WHEN NOT json_valid(value) THEN 'bad_json' END AS reason
    FROM messages
), documents_only AS (
    SELECT event_id, ts, CASE WHEN reason IS NULL THEN value END AS doc, reason FROM checked
), typed AS (
    SELECT event_id, ts, reason, doc,
        CASE WHEN json_type(doc, '$.name') = 'VARCHAR' THEN doc ->> '$.name' END AS name,
        CASE WHEN json_type(doc, '$.size') = 'VARCHAR' THEN doc ->> '$.size' END AS size,
        CASE WHEN json_type(doc, '$.count') IN ('UBIGINT', 'BIGINT')
            THEN CAST(doc ->> '$.count' AS BIGINT) END AS "count"
    FROM documents_only
), valid AS (
    SELECT event_id, ts, name, size, "count" FROM typed WHERE reason IS NULL
)
"""

_SCALARS = """
WITH messages AS (
    SELECT event_id,
        '{"flag":' || CASE WHEN event_id % 11 = 0 THEN '"true"' WHEN event_id % 6 = 0 THEN '1'
            WHEN event_id % 4 = 0 THEN 'false' ELSE 'true' END
        || ',"score":' || CASE WHEN event_id % 7 = 0 THEN '"1.5"'
            WHEN event_id % 5 = 0 THEN CAST(user_id AS VARCHAR)
            WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) || '.25'
            WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) || 'e2' ELSE 'null' END
        || ',"code":' || CAST(event_id * 1000003 AS VARCHAR) || '}' AS value
    FROM events
)
"""


def _numbered(table: str, columns: str, micros: int) -> str:
    """Rows of a table with the number of their arrival window, and where windows start."""
    return f"""
    origin AS (SELECT min(ts) AS t0, max(ts) AS t1 FROM events),
    numbered AS (
        SELECT {columns}, t0, t1, (epoch_us(ts) - epoch_us(t0)) // {micros} + 1 AS window_no
        FROM {table}, origin
    )
    """


def _described(micros: int) -> str:
    return f"""
        window_no, 'window-' || window_no AS window_id,
        t0 + to_microseconds((window_no - 1) * {micros}) AS window_start,
        t0 + to_microseconds(window_no * {micros}) AS window_end
    """


_15S = 15 * 10**6
_6H = 6 * 3600 * 10**6


def _tumbling_sql(interval: str) -> str:
    return f"""
        SELECT time_bucket(INTERVAL '{interval}', ts) AS window_start,
            time_bucket(INTERVAL '{interval}', ts) + INTERVAL '{interval}' AS window_end,
            count(*) AS rows
        FROM events GROUP BY ALL
    """


def oracle_sql() -> dict[str, str]:
    """For each query, the SQL that DuckDB runs on the same tables."""
    batched = "SELECT *, event_id // 100 AS batch_id FROM events"
    partition_order = f"""
        SELECT event_id, batch_id, key,
            row_number() OVER (PARTITION BY key ORDER BY batch_id, event_id) AS position
        FROM (SELECT event_id, batch_id, user_id % 10 AS key FROM ({batched}))
        WHERE key IS NOT NULL
    """
    partition_order_hot = f"""
        SELECT event_id, batch_id, key,
            row_number() OVER (PARTITION BY key ORDER BY batch_id, event_id) AS position
        FROM (SELECT event_id, batch_id, CASE WHEN event_id % 3 = 0 THEN 7
                WHEN event_id % 11 <> 0 THEN user_id % 10 END AS key FROM ({batched}))
        WHERE key IS NOT NULL
    """
    changes = """
        SELECT event_id, ts, CASE WHEN event_id % 13 <> 0 THEN user_id END AS user_id,
            event_type, value FROM events
    """
    hot_changes = """
        SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 7
            WHEN event_id % 13 <> 0 THEN user_id END AS user_id, event_type, value FROM events
    """
    numbered_changes = """
        SELECT event_id, ts, user_id, event_type, value,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS change_no
        FROM ({}) WHERE user_id IS NOT NULL
    """
    stats = f"""
        WITH batched AS ({batched}), {_numbered("batched", "batch_id", _6H)}, stats AS (
            SELECT {_described(_6H)}, count(*) AS rows, count(DISTINCT batch_id) AS batches
            FROM numbered GROUP BY window_no, t0
        )
    """
    return {
        "decode_status": _MESSAGES
        + "SELECT event_id, coalesce(reason, 'valid') AS status FROM checked",
        "parse_valid": _MESSAGES + "SELECT event_id, value FROM checked WHERE reason IS NULL",
        "dead_letters": _MESSAGES
        + "SELECT event_id, value, reason FROM checked WHERE reason IS NOT NULL",
        "error_counts": _MESSAGES
        + "SELECT reason, count(*) AS rows FROM checked WHERE reason IS NOT NULL GROUP BY reason",
        **dict.fromkeys(
            ("first_n_valid", "first_n_valid_in_steps", "stream_first_n_valid"),
            _MESSAGES
            + f"""SELECT event_id, value FROM checked WHERE reason IS NULL
                ORDER BY event_id LIMIT {FIRST_N}""",
        ),
        "typed_projection": _MESSAGES + 'SELECT event_id, name, size, "count" FROM valid',
        "typed_scalars": _SCALARS
        + """SELECT event_id,
            CASE WHEN json_type(value, '$.flag') = 'BOOLEAN'
                THEN CAST(value ->> '$.flag' AS BOOLEAN) END AS flag,
            CASE WHEN json_type(value, '$.score') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
                THEN CAST(value ->> '$.score' AS DOUBLE) END AS score
            FROM messages""",
        "int32_overflow": """
            SELECT event_id,
                CASE WHEN code BETWEEN -2147483648 AND 2147483647
                    THEN CAST(code AS INTEGER) END AS or_null,
                CAST(((code + 2147483648) % 4294967296) - 2147483648 AS INTEGER) AS wrapped
            FROM (SELECT event_id, event_id * 1000003 AS code FROM events)""",
        "required_fields": _MESSAGES
        + """SELECT event_id, CASE WHEN reason IS NOT NULL THEN reason
                WHEN json_type(doc, '$.name') IS NULL OR json_type(doc, '$.count') IS NULL
                    THEN 'missing_required'
                WHEN name IS NULL OR "count" IS NULL THEN 'null_required' END AS reason
            FROM typed""",
        "props_projection": """
            SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT')
                THEN CAST(props ->> '$.k' AS BIGINT) END AS k
            FROM (SELECT event_id, CASE WHEN json_valid(props) THEN props END AS props FROM events)
            WHERE props IS NOT NULL""",
        "arrival_window": f"""
            WITH {_numbered("events", "event_id", _15S)}
            SELECT event_id, {_described(_15S)} FROM numbered""",
        "closed_windows": f"""
            WITH {_numbered("events", "event_id", _6H)}
            SELECT {_described(_6H)}, count(*) AS rows FROM numbered
            GROUP BY window_no, t0, t1
            HAVING t0 + to_microseconds(window_no * {_6H}) <= t1""",
        "window_stats": stats + "SELECT * FROM stats",
        "current_window": stats
        + "SELECT window_id, batches, rows FROM stats ORDER BY window_no DESC LIMIT 1",
        "windows_with_empty": f"""
            WITH {_numbered("events", "event_id", _15S)}, counts AS (
                SELECT window_no, count(*) AS n FROM numbered GROUP BY window_no
            ), spine AS (
                SELECT t0, CAST(unnest(generate_series(1, (SELECT max(window_no) FROM numbered)))
                    AS BIGINT) AS window_no
                FROM origin
            )
            SELECT {_described(_15S)}, coalesce(n, 0) AS rows
            FROM spine LEFT JOIN counts USING (window_no)""",
        "windows_with_empty_origin": f"""
            WITH ends AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b FROM events
            ), middle AS (SELECT a, b, (a + b) // 2 AS m FROM ends
            ), numbers AS (
                SELECT CAST(floor((epoch_us(ts) - m) / {_6H}::DOUBLE) AS BIGINT) + 1 AS window_no, m
                FROM events, middle
            ), counts AS (SELECT window_no, count(*) AS n FROM numbers GROUP BY window_no
            ), spine AS (
                SELECT m, CAST(unnest(generate_series((SELECT min(window_no) FROM counts),
                    (SELECT max(window_no) FROM counts))) AS BIGINT) AS window_no FROM middle
            )
            SELECT window_no, 'window-' || window_no AS window_id, coalesce(n, 0) AS rows,
                make_timestamp(m + (window_no - 1) * {_6H}) AS window_start,
                make_timestamp(m + window_no * {_6H}) AS window_end
            FROM spine LEFT JOIN counts USING (window_no)""",
        "null_time_report": """SELECT count_if(event_id % 7 <> 0) AS timed_rows,
            count_if(event_id % 7 = 0) AS null_time_rows FROM events""",
        "count_windows": _MESSAGES
        + f"""SELECT event_id, value, ordinal, (ordinal - 1) // {COUNT_SIZE} AS batch_no FROM (
                SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS ordinal
                FROM checked WHERE reason IS NULL)""",
        "tumbling_15s": _tumbling_sql("15 seconds"),
        "tumbling_6h": _tumbling_sql("6 hours"),
        "window_partition_stats": _MESSAGES
        + f""", {_numbered("valid", '"count"', _6H)}
            SELECT "count", {_described(_6H)}, count(*) AS rows FROM numbered
            WHERE "count" IS NOT NULL GROUP BY window_no, t0, "count" """,
        "partition_split": "SELECT * FROM lineitem WHERE l_suppkey IS NOT NULL",
        "partition_split_in_order": "SELECT * FROM events WHERE user_id IS NOT NULL",
        "null_key_report": _MESSAGES
        + """SELECT count("count") AS keyed_rows, count(*) - count("count") AS null_key_rows
            FROM valid""",
        "append_batches": """
            SELECT * FROM events WHERE coalesce(event_type = 'error' OR value >= 10, false)
            UNION ALL SELECT * FROM events WHERE NOT coalesce(event_type = 'error', false)""",
        "partition_sizes": _MESSAGES
        + """SELECT "count", count(*) AS rows FROM valid
            WHERE "count" IS NOT NULL GROUP BY "count" """,
        "partition_count": _MESSAGES + 'SELECT count(DISTINCT "count") AS partitions FROM valid',
        "partition_order": partition_order,
        "partition_order_hot": partition_order_hot,
        "written_partitions": _MESSAGES
        + 'SELECT name, size, "count" FROM valid WHERE "count" IS NOT NULL',
        "manifest": _MESSAGES
        + """SELECT "count", count(*) AS rows, true AS has_files FROM valid
            WHERE "count" IS NOT NULL GROUP BY "count" """,
        "ingested_partitions": _MESSAGES
        + """SELECT name, size, "count", CAST(NULL AS VARCHAR) AS value, 'valid' AS status
            FROM valid WHERE "count" IS NOT NULL
            UNION ALL SELECT NULL, NULL, NULL, value, reason FROM checked
            WHERE reason IS NOT NULL""",
        "ingested_table": _MESSAGES
        + """SELECT name, size, "count", CAST(3 AS BIGINT) AS batch_id FROM valid
            WHERE "count" IS NOT NULL""",
        "ingested_count_windows": _MESSAGES
        + f"""SELECT batch_no, "count", count(*) AS rows FROM (
                SELECT "count", (row_number() OVER (ORDER BY event_id) - 1) // {COUNT_SIZE}
                    AS batch_no FROM valid)
            WHERE "count" IS NOT NULL GROUP BY ALL""",
        "cdc_split": f"SELECT * FROM ({changes}) WHERE user_id IS NOT NULL",
        "cdc_order": numbered_changes.format(changes),
        "cdc_order_hot": numbered_changes.format(hot_changes),
        "cdc_latest": f"""
            SELECT event_id, ts, user_id, event_type, value FROM (
                SELECT *, row_number() OVER (
                    PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back
                FROM ({changes}) WHERE user_id IS NOT NULL)
            WHERE back = 1 AND event_type <> 'error'""",
        "padded_payloads": """
            WITH sent AS (
                SELECT event_id, event_id % 10 AS worker, (event_id // 10) % 100000 AS id
                FROM events
            ), ends AS (
                SELECT event_id, worker,
                    '","id":' || id || ',"message":"Message ' || id || '"}' AS tail
                FROM sent
            ), texts AS (
                SELECT event_id, worker,
                    '{"data":"' || repeat('A', 1024 - 9 - CAST(strlen(tail) AS INTEGER)) || tail
                        AS value
                FROM ends
            )
            SELECT event_id, worker, value, CAST(strlen(value) AS INTEGER) AS bytes FROM texts""",
        "worker_throughput": """
            SELECT user_id, count(*) AS messages, date_diff('microsecond', min(ts), max(ts)) AS micros,
                CAST(count(*) AS DOUBLE) * 1000000
                    / nullif(date_diff('microsecond', min(ts), max(ts)), 0) AS per_second
            FROM events GROUP BY user_id""",
        "total_throughput": """
            SELECT count(*) AS messages, date_diff('microsecond', min(ts), max(ts)) AS micros,
                CAST(count(*) AS DOUBLE) * 1000000
                    / nullif(date_diff('microsecond', min(ts), max(ts)), 0) AS per_second
            FROM events""",
        **event_queries.oracle_sql(),
        **_training_data_sql(),
    }

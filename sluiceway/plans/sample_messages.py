"""Messages made from the rows of an ``events`` table, some of them broken on purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame

MESSAGE = "name STRING, size STRING, count BIGINT"
SCALARS = "flag BOOLEAN, score DOUBLE"
CODE = "code INT"

_HEAD = """concat('{"name":"', event_type, '","size":"', if(value < 10, 'small', 'large'), '"')"""
_DIGIT = "string(user_id % 10)"
_WHOLE = f"""concat({_HEAD}, ',"count":', {_DIGIT}, '}}')"""

_EVENT = f"""CASE
    WHEN event_id % 97 = 0 THEN '{{bad'
    WHEN event_id % 89 = 0 THEN concat({_WHOLE}, ' trailing')
    WHEN event_id % 83 = 0 THEN concat({_HEAD}, ',"count":"', {_DIGIT}, '"}}')
    WHEN event_id % 79 = 0 THEN concat({_HEAD}, ',"count":', {_DIGIT}, '.5}}')
    WHEN event_id % 73 = 0 THEN concat({_HEAD}, '}}')
    WHEN event_id % 71 = 0 THEN concat({_HEAD}, ',"count":null}}')
    ELSE {_WHOLE} END AS value"""

_FLAG = """CASE WHEN event_id % 11 = 0 THEN '"true"' WHEN event_id % 6 = 0 THEN '1'
    WHEN event_id % 4 = 0 THEN 'false' ELSE 'true' END"""
_SCORE = """CASE WHEN event_id % 7 = 0 THEN '"1.5"'
    WHEN event_id % 5 = 0 THEN string(user_id)
    WHEN event_id % 3 = 0 THEN concat(string(user_id), '.25')
    WHEN event_id % 2 = 0 THEN concat(string(user_id), 'e2') ELSE 'null' END"""
_SCALAR = f"""concat('{{"flag":', {_FLAG}, ',"score":', {_SCORE},
    ',"code":', string(event_id * 1000003), '}}') AS value"""


def event_messages(events: DataFrame) -> DataFrame:
    """``event_id``, ``ts`` and ``value``: ``{"name", "size", "count": user_id % 10}``."""
    return events.selectExpr("event_id", "ts", _EVENT)


def scalar_messages(events: DataFrame) -> DataFrame:
    """``event_id`` and ``value``: ``{"flag", "score", "code": event_id * 1000003}``."""
    return events.selectExpr("event_id", _SCALAR)

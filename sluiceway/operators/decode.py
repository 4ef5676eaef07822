"""Decode raw message payloads and separate the malformed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.functions import strict_json
from sluiceway.session import allow_duplicate_keys

DOC = "doc"
REASON = "reason"
BAD_PAYLOAD = "bad_payload"
BAD_JSON = "bad_json"
TOO_LARGE = "too_large"
# Spark's JSON parser reads no string of more characters and no number of more digits.
MOST_CHARACTERS, MOST_DIGITS = 20_000_000, 1000

_TEXT = "_text"


def decode(df: DataFrame, value: str = "value") -> DataFrame:
    """Add ``doc`` (VARIANT, null if malformed) and ``reason`` (null if valid).

    A payload, binary or string, must be valid UTF-8 and exactly one JSON document. One that
    could not be parsed and is beyond the parser's limits is ``too_large``, be it well formed
    or not.
    """
    for name in (DOC, REASON, _TEXT):
        if name in df.columns:
            raise ValueError(f"Column {name} already exists")
    allow_duplicate_keys(df.sparkSession)
    payload = f"CAST({strict_json.sql_name(value)} AS STRING)"
    readable = df.selectExpr("*", f"IF(is_valid_utf8({payload}), {payload}, NULL) AS {_TEXT}")
    # A filter on the outcome would otherwise be pushed below the parse and repeat it.
    parsed = readable.selectExpr("*", f"explode(array({strict_json.bracketed(_TEXT)})) AS {DOC}")
    return parsed.selectExpr(
        *map(strict_json.sql_name, df.columns),
        DOC,
        f"""CASE WHEN {_TEXT} IS NULL THEN '{BAD_PAYLOAD}'
            WHEN {strict_json.is_single(DOC)} THEN NULL
            WHEN {_beyond_parser(_TEXT)} THEN '{TOO_LARGE}'
            ELSE '{BAD_JSON}' END AS {REASON}""",
    )


def _beyond_parser(text: str) -> str:
    return f"length({text}) > {MOST_CHARACTERS} OR {text} RLIKE r'[0-9]{{{MOST_DIGITS + 1}}}'"


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col(REASON).isNull())


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.col(REASON).isNotNull())


def error_counts(df: DataFrame) -> DataFrame:
    """Rows per reason; the grouping combines on the map side."""
    return rejected(df).groupBy(REASON).agg(F.count("*").alias("rows"))


def first_n_valid(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """The first ``n`` valid rows in the given order; malformed rows do not count."""
    return accepted(df).orderBy(*order_by).limit(n)

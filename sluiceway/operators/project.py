"""Project decoded documents onto a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sluiceway.functions.strict_json import as_int32, is_missing, sql_name, sql_string, typed_field
from sluiceway.operators.decode import DOC, REASON, accepted
from sluiceway.schema import message_schema, no_repeated_names

MISSING_REQUIRED = "missing_required"
NULL_REQUIRED = "null_required"


def project(
    df: DataFrame,
    schema: T.StructType | str,
    keep: tuple[str, ...] = (),
    int32_overflow: str = "null",
) -> DataFrame:
    """Typed columns for every decoded row, after the columns named in ``keep``.

    ``reason`` is kept, and set for rows that lack a required (not nullable) field:
    ``missing_required`` if a field is absent, else ``null_required`` if one is null
    or of another type.
    """
    schema = message_schema(schema)
    _check_options(schema, keep, int32_overflow)
    reason = f"coalesce({REASON}, {_required_reason(schema, int32_overflow)}) AS {REASON}"
    typed = df.selectExpr(*map(sql_name, keep), *_typed(schema), reason)
    return _narrowed(typed, schema, int32_overflow)


def project_strict(
    df: DataFrame,
    schema: T.StructType | str,
    keep: tuple[str, ...] = (),
    int32_overflow: str = "null",
) -> DataFrame:
    """Typed columns of the valid rows; the job fails at the first required field not there."""
    schema = message_schema(schema)
    _check_options(schema, keep, int32_overflow)
    required = _required(schema)
    checks = [f"WHEN {REASON} IS NOT NULL THEN true"]
    checks += [
        f"WHEN {is_missing(DOC, f.name)} THEN "
        f"raise_error({sql_string(f'The required field {f.name} is absent')})"
        for f in required
    ]
    checks += [
        f"WHEN {typed_field(DOC, f.name, f.dataType, int32_overflow)} IS NULL THEN "
        f"raise_error({sql_string(f'The required field {f.name} is null')})"
        for f in required
    ]
    # Checked in a filter, which column pruning cannot remove.
    checked = accepted(df).filter(f"CASE {' '.join(checks)} ELSE true END")
    typed = checked.selectExpr(*map(sql_name, keep), *_typed(schema))
    return _narrowed(typed, schema, int32_overflow)


def _required(schema: T.StructType) -> list[T.StructField]:
    return [field for field in schema.fields if not field.nullable]


def _typed(schema: T.StructType) -> list[str]:
    """The fields, those of 32 bits still with 64."""
    wide = {T.IntegerType(): T.LongType()}
    return [
        f"{typed_field(DOC, f.name, wide.get(f.dataType, f.dataType))} AS {sql_name(f.name)}"
        for f in schema.fields
    ]


def _narrowed(typed: DataFrame, schema: T.StructType, int32_overflow: str) -> DataFrame:
    """A second step, so that an integer compared with its bounds is read only once."""
    narrow = {f.name for f in schema.fields if isinstance(f.dataType, T.IntegerType)}
    if not narrow:
        return typed
    return typed.selectExpr(
        *[
            f"{as_int32(sql_name(c), int32_overflow)} AS {sql_name(c)}"
            if c in narrow
            else sql_name(c)
            for c in typed.columns
        ]
    )


def _required_reason(schema: T.StructType, int32_overflow: str) -> str:
    required = _required(schema)
    if not required:
        return "NULL"
    missing = " OR ".join(is_missing(DOC, f.name) for f in required)
    null = " OR ".join(
        f"{typed_field(DOC, f.name, f.dataType, int32_overflow)} IS NULL" for f in required
    )
    return f"CASE WHEN {missing} THEN '{MISSING_REQUIRED}' WHEN {null} THEN '{NULL_REQUIRED}' END"


def _check_options(schema: T.StructType, keep: tuple[str, ...], int32_overflow: str) -> None:
    if int32_overflow not in ("null", "wrap"):
        raise ValueError(f"int32_overflow must be 'null' or 'wrap', not {int32_overflow!r}")
    no_repeated_names([*keep, *schema.names, REASON])

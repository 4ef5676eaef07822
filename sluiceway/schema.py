"""Checks on declared schemas, made while the plan is built and before any job starts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

FIELD_TYPES = (T.LongType, T.IntegerType, T.StringType, T.DoubleType, T.BooleanType)


def message_schema(schema: T.StructType | str) -> T.StructType:
    """Validate the declared schema of a message; a DDL string is accepted too."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if not schema.fields:
        raise ValueError("a message schema needs at least one field")
    for field in schema.fields:
        if not isinstance(field.dataType, FIELD_TYPES):
            raise ValueError(
                f"Unsupported data type for field {field.name!r}: {field.dataType.simpleString()}"
            )
        # The JSON path syntax has no escape for these.
        if not field.name or "?" in field.name or ("'" in field.name and '"' in field.name):
            raise ValueError(f"Field name {field.name!r} cannot be used in a JSON path")
    no_repeated_names(schema.names)
    return schema


def no_repeated_names(names: list[str]) -> None:
    folded = [name.lower() for name in names]
    repeated = sorted({name for name in folded if folded.count(name) > 1})
    if repeated:
        raise ValueError(f"Column names repeat: {', '.join(repeated)}")


def partition_key(df: DataFrame, key: str) -> str:
    """The key column must exist and be a 64-bit integer."""
    if key not in df.columns:
        raise ValueError(f"There is no column {key}")
    found = df.schema[key].dataType
    if not isinstance(found, T.LongType):
        raise ValueError(f"Partition column {key} must be bigint, not {found.simpleString()}")
    return key


def same_schema(left: DataFrame, right: DataFrame) -> None:
    """Equal names and types in equal order; nullability may differ."""
    a = [(f.name, f.dataType) for f in left.schema.fields]
    b = [(f.name, f.dataType) for f in right.schema.fields]
    if a != b:
        raise ValueError(
            f"The schemas differ: {left.schema.simpleString()} and {right.schema.simpleString()}"
        )

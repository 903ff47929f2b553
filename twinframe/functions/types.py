"""Type families: which Spark types count as comparable."""

from __future__ import annotations

import re

from pyspark.sql import types as T

NUMERIC, STRING, DATETIME, BOOLEAN, BINARY, NESTED = (
    "numeric",
    "string",
    "datetime",
    "boolean",
    "binary",
    "nested",
)

_CHAR_VARCHAR_KEY = "__CHAR_VARCHAR_TYPE_STRING"


def family(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType, T.NullType)):
        return STRING
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, T.BinaryType):
        return BINARY
    return NESTED


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DecimalType)


def contains_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return contains_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(contains_map(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.VariantType)


def compatible(source: T.DataType, target: T.DataType) -> bool:
    """Equal types, or two types of one comparable family."""
    if source == target:
        return True
    shared = family(source)
    return shared == family(target) and shared != NESTED


def declared_length(field: T.StructField) -> int | None:
    """Length of a char/varchar column, kept by Spark in the field's metadata."""
    text = field.metadata.get(_CHAR_VARCHAR_KEY, "") if field.metadata else ""
    found = re.fullmatch(r"(?:var)?char\((\d+)\)", text)
    return int(found.group(1)) if found else None


def precision_scale(field: T.StructField) -> tuple[int, int] | None:
    if isinstance(field.dataType, T.DecimalType):
        return field.dataType.precision, field.dataType.scale
    return None

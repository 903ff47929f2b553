"""Canonical text of a value, and equality across types. Functions take a SQL expression and return one.

Two values are equal when their canonical texts are equal. The text carries a family tag: ``n:`` number,
``s:`` string, ``t:`` date or time, ``b:`` bytes that are not text, ``j:`` nested.
"""

from __future__ import annotations

from pyspark.sql import types as T

from twinframe.functions import types as ty
from twinframe.functions.text import as_double, nested_text, strip_ws, timestamp_text

# Which texts count as an integer or a decimal number. No exponents, no bare leading point.
INTEGER_TEXT = "^[+-]?[0-9]+$"
DECIMAL_TEXT = "^[+-]?[0-9]+[.][0-9]*$"

_LONG_LIMIT = f"{float(2**63)!r}D"
_SPLIT = f"{float(2**62)!r}D"
_SPLIT_LIMIT = f"{float(2**115)!r}D"


def integer_canon(digits: str) -> str:
    """Integer text of any length without plus sign and leading zeros."""
    bare = f"regexp_replace({digits}, '^[+]?(-?)0*(?=[0-9])', '$1')"
    return f"concat('n:', CASE WHEN {bare} = '-0' THEN '0' ELSE {bare} END)"


def number_canon(x: str) -> str:
    """Exact digits of a whole double, else its shortest text."""
    size = f"abs({x})"
    # Beyond the long range a double is still top * 2^62 + rest with both parts exact.
    top = f"CAST(floor({x} / {_SPLIT}) AS BIGINT)"
    rest = f"CAST({x} - CAST({top} AS DOUBLE) * {_SPLIT} AS BIGINT)"
    wide = f"CAST({top} AS DECIMAL(18,0)) * CAST({2**62} AS DECIMAL(19,0)) + CAST({rest} AS DECIMAL(19,0))"
    return f"""concat('n:', CASE
      WHEN {size} < {_LONG_LIMIT} AND {x} = rint({x}) THEN CAST(TRY_CAST({x} AS BIGINT) AS STRING)
      WHEN {size} >= {_LONG_LIMIT} AND {size} < {_SPLIT_LIMIT} THEN CAST(CAST({wide} AS DECIMAL(38,0)) AS STRING)
      ELSE CAST({x} AS STRING) END)"""


def canon_text(x: str) -> str:
    """Canonical form of a string: numbers by value, everything else as stripped text."""
    bare = strip_ws(x)
    return f"""CASE
      WHEN {bare} RLIKE '{INTEGER_TEXT}' THEN {integer_canon(bare)}
      WHEN {bare} RLIKE '{DECIMAL_TEXT}' THEN {number_canon(f"TRY_CAST({bare} AS DOUBLE)")}
      ELSE concat('s:', {bare}) END"""


def canon(x: str, dtype: T.DataType) -> str:
    kind = ty.family(dtype)
    if kind == ty.STRING:
        return canon_text(f"CAST({x} AS STRING)")
    if kind == ty.BOOLEAN:
        return f"CASE WHEN {x} THEN 'n:1' WHEN NOT {x} THEN 'n:0' END"
    if kind == ty.DATETIME:
        return f"concat('t:', {timestamp_text(x)})"
    if kind == ty.BINARY:
        text = f"try_validate_utf8(CAST({x} AS STRING))"
        return f"coalesce({canon_text(text)}, concat('b:', hex({x})))"
    if kind == ty.NESTED:
        return f"concat('j:', {nested_text(x, dtype)})"
    if ty.is_integral(dtype) or (isinstance(dtype, T.DecimalType) and dtype.scale == 0):
        return f"concat('n:', CAST({x} AS STRING))"
    if isinstance(dtype, T.DecimalType):
        fraction = number_canon(f"CAST({x} AS DOUBLE)")
        return f"CASE WHEN {x} = floor({x}) THEN concat('n:', CAST(floor({x}) AS STRING)) ELSE {fraction} END"
    number = as_double(x, dtype)
    return f"CASE WHEN NOT isnan({number}) THEN {number_canon(number)} END"


def canon_strict(x: str, dtype: T.DataType) -> str:
    """Canonical form that leaves strings as they are: the text ``1`` never equals the number 1."""
    return f"concat('s:', CAST({x} AS STRING))" if ty.family(dtype) == ty.STRING else canon(x, dtype)


def nan_as_null(x: str, dtype: T.DataType) -> str:
    return f"CASE WHEN NOT isnan({x}) THEN {x} END" if ty.is_floating(dtype) else x


def is_missing(x: str, dtype: T.DataType) -> str:
    return f"({x} IS NULL OR isnan({x}))" if ty.is_floating(dtype) else f"({x} IS NULL)"


def values_equal(s: str, t: str, source_type: T.DataType, target_type: T.DataType) -> str:
    """Equality under canonicalisation; never NULL.

    Columns of one type are compared natively, so the canonical text is only built where the types differ
    or where two strings differ as written.
    """
    kinds = {ty.family(source_type), ty.family(target_type)}
    same = source_type == target_type
    if same and ty.is_floating(source_type):
        nan = f"CAST('NaN' AS {source_type.simpleString()})"
        return f"(coalesce({s}, {nan}) = coalesce({t}, {nan}))"
    if kinds == {ty.STRING} or kinds == {ty.BINARY}:
        return f"({s} <=> {t} OR {canon(s, source_type)} <=> {canon(t, target_type)})"
    if kinds == {ty.DATETIME} and not same:
        return f"(CAST({s} AS TIMESTAMP_NTZ) <=> CAST({t} AS TIMESTAMP_NTZ))"
    both_integral = ty.is_integral(source_type) and ty.is_integral(target_type)
    if both_integral or (same and not ty.contains_map(source_type)):
        return f"({s} <=> {t})"
    return f"({canon(s, source_type)} <=> {canon(t, target_type)})"

"""Cells taken out of their columns: a value as plain text together with the kind of column it came from.

Checks on differing cells are written once over (text, kind) instead of once per column, so that plans and
generated code stay the same size however wide the tables are. Functions take SQL expressions and return one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.functions import canon as cn
from twinframe.functions import text as tx
from twinframe.functions import types as ty

INT, FLOAT, DECIMAL, BOOL, STRING, BYTES, DATE, TIME, NESTED = (
    "int",
    "float",
    "decimal",
    "bool",
    "string",
    "bytes",
    "date",
    "time",
    "nested",
)
TEXT_KINDS = (STRING, BYTES, NESTED)
#: Kinds whose cells, where both sides have it and they may differ, do so whatever their spelling, and are no texts.
DIFFER_AS_THEY_ARE = (INT, FLOAT, BOOL, DATE, TIME)


def kind_of(dtype: T.DataType) -> str:
    if ty.is_integral(dtype):
        return INT
    if ty.is_floating(dtype):
        return FLOAT
    if isinstance(dtype, T.DecimalType):
        return DECIMAL
    if isinstance(dtype, T.DateType):
        return DATE
    return {ty.BOOLEAN: BOOL, ty.STRING: STRING, ty.BINARY: BYTES, ty.DATETIME: TIME, ty.NESTED: NESTED}[
        ty.family(dtype)
    ]


def raw(x: str, dtype: T.DataType) -> str:
    """Text from which the value can be read back; NaN counts as missing."""
    kind = kind_of(dtype)
    if kind in (BYTES, NESTED):
        return tx.value_text(x, dtype)
    if kind == TIME:
        return f"CAST(CAST({x} AS TIMESTAMP_NTZ) AS STRING)"
    return f"CAST({cn.nan_as_null(x, dtype)} AS STRING)"


def may_differ(s: str, t: str, s_type: T.DataType, t_type: T.DataType) -> str:
    """Cheap test that holds for every pair of cells some check could object to; never NULL."""
    kinds = kind_of(s_type), kind_of(t_type)
    if s_type == t_type and FLOAT in kinds:
        return f"(NOT {cn.values_equal(s, t, s_type, t_type)})"
    if kinds == (INT, INT) or (s_type == t_type and not ty.contains_map(s_type)):
        return f"(NOT {s} <=> {t})"
    if set(kinds) <= {INT, STRING}:
        return f"(NOT {raw(s, s_type)} <=> {raw(t, t_type)})"
    return f"(NOT {cn.is_missing(s, s_type)} OR NOT {cn.is_missing(t, t_type)})"


def text_differs(s: str, t: str, s_type: T.DataType, t_type: T.DataType) -> str:
    """Whether two values are spelled differently in a row's hash."""
    if s_type == t_type and kind_of(s_type) != STRING:
        return may_differ(s, t, s_type, t_type)
    return f"({tx.present_text(s, s_type)} <> {tx.present_text(t, t_type)})"


def differing_cell(c: int, s: str, t: str, s_type: T.DataType, t_type: T.DataType) -> str:
    """A struct ``c, sv, tv`` where two cells may differ, else NULL."""
    cell = f"named_struct('c', {c}, 'sv', {raw(s, s_type)}, 'tv', {raw(t, t_type)})"
    return f"CASE WHEN {may_differ(s, t, s_type, t_type)} THEN {cell} END"


def _in(kind: str, *kinds: str) -> str:
    return f"{kind} IN ({', '.join(repr(k) for k in kinds)})"


def described(df: DataFrame, sides: dict[str, str]) -> DataFrame:
    """Add ``<text>_plain`` and ``<text>_canon`` for each text column and its kind column in ``sides``.

    Every step is a column of its own, so that later steps refer to it instead of repeating it.
    """

    def step(df: DataFrame, suffix: str, expression) -> DataFrame:
        added = {f"{x}_{suffix}": F.expr(expression(x, kind)) for x, kind in sides.items()}
        return df.withColumns(added)

    df = step(df, "bare", lambda x, k: f"CASE WHEN {_in(k, STRING, BYTES)} THEN {tx.strip_ws(x)} ELSE {x} END")
    df = step(df, "number", lambda x, k: _number(f"{x}_bare", k))
    df = step(df, "plain", lambda x, k: plain_text(x, k, f"{x}_number"))
    return step(df, "canon", lambda x, k: _canon(f"{x}_bare", k, f"{x}_number"))


def differs(s_kind: str, t_kind: str, s_canon: str, t_canon: str) -> str:
    """Whether two cells that may differ have different values."""
    native = f"({s_kind} = {t_kind} AND NOT {_in(s_kind, STRING, BYTES, DECIMAL)})"
    return f"({native} OR NOT {s_canon} <=> {t_canon})"


def is_texty(kind: str) -> str:
    return f"({_in(kind, *TEXT_KINDS)})"


def _number(bare: str, kind: str) -> str:
    """The cell as a double where it is a fractional number."""
    spelled = f"({_in(kind, STRING, BYTES)} AND {bare} RLIKE '{cn.DECIMAL_TEXT}')"
    return f"CASE WHEN {_in(kind, FLOAT, DECIMAL)} OR {spelled} THEN TRY_CAST({bare} AS DOUBLE) END"


def _canon(bare: str, kind: str, number: str) -> str:
    """Canonical text of a cell."""
    whole = (
        f"{kind} = '{INT}' OR ({_in(kind, STRING, BYTES)} AND {bare} RLIKE '{cn.INTEGER_TEXT}') "
        f"OR ({kind} = '{DECIMAL}' AND {bare} RLIKE r'^-?[0-9]+(\\.0*)?$')"
    )
    moment = tx.timestamp_text(f"TRY_CAST({bare} AS TIMESTAMP_NTZ)")
    digits = f"regexp_replace({bare}, r'\\..*$', '')"
    return f"""CASE
      WHEN {whole} THEN {cn.integer_canon(digits)}
      WHEN {number} IS NOT NULL THEN {cn.number_canon(number)}
      WHEN {kind} = '{BOOL}' THEN CASE {bare} WHEN 'true' THEN 'n:1' WHEN 'false' THEN 'n:0' END
      WHEN {_in(kind, DATE, TIME)} THEN concat('t:', {moment})
      WHEN {kind} = '{NESTED}' THEN concat('j:', {bare})
      ELSE concat('s:', {bare}) END"""


def plain_text(x: str, kind: str, number: str | None = None) -> str:
    """Plain text of a cell as reports spell it, ``None`` when missing."""
    moment = tx.timestamp_text(f"TRY_CAST({x} AS TIMESTAMP_NTZ)")
    return f"""coalesce(CASE
      WHEN {kind} = '{FLOAT}' THEN {tx.float_text(number or f"TRY_CAST({x} AS DOUBLE)")}
      WHEN {kind} = '{TIME}' THEN {moment}
      WHEN {kind} = '{BOOL}' THEN initcap({x})
      ELSE {x} END, '{tx.MISSING_TEXT}')"""


def shown(x: str, kind: str, plain: str) -> str:
    """How a report shows a cell, see ``text.display``."""
    day = f"TRY_CAST({x} AS DATE)"
    return f"""CASE
      WHEN {x} IS NULL THEN '{tx.MISSING_TEXT}'
      WHEN {kind} = '{STRING}' THEN {tx.quoted(x)}
      WHEN {kind} = '{DATE}' THEN format_string('datetime.date(%d, %d, %d)', year({day}), month({day}), day({day}))
      WHEN {kind} = '{TIME}' THEN concat('Timestamp(\\'', {plain}, '\\')')
      WHEN {kind} = '{DECIMAL}' THEN concat('Decimal(\\'', {x}, '\\')')
      ELSE {plain} END"""

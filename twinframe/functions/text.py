"""Text forms of values: trimming, display text and short names.

Functions take a SQL expression and return one. A caller hands the whole to Spark with one ``F.expr``, which
is much faster to build than nested Column calls when there are hundreds of columns.
"""

from __future__ import annotations

from pyspark.sql import types as T

from twinframe.functions import types as ty

# Report limits and the text shown for a missing value.
REPR_LIMIT = 100
SIGNOFF_DETAIL_LIMIT = 120
SLUG_LIMIT = 40
MISSING_TEXT = "None"

# Every character Unicode counts as white space; Spark's trim() alone removes spaces only.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def ident(name: str) -> str:
    """A column name as SQL."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A text as SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip_ws(x: str) -> str:
    return f"btrim({x}, '{WHITESPACE}')"


def float_text(x: str) -> str:
    """Shortest decimal text of a double: positional from 1e-4 up to 1e16, else with a two-digit exponent.

    Numbers below 2.3e-308 are spelled as Java does, which may use one digit more.
    """
    spelled, size = f"CAST({x} AS STRING)", f"abs({x})"
    # Some Java versions spell a double with more digits than identify it: try fewer first.
    tries = [f"format_string('%.{places}e', {x})" for places in (13, 14, 15, 16)]
    shorter = " ".join(f"WHEN TRY_CAST({t} AS DOUBLE) = {x} THEN {t}" for t in tries)
    digits = f"CASE WHEN length({spelled}) < 18 THEN {spelled} {shorter} ELSE {spelled} END"
    positional = f"regexp_replace(CAST(TRY_CAST({digits} AS DECIMAL(38,20)) AS STRING), r'(\\.[0-9]+?)0+$', '$1')"
    exponent = f"regexp_replace(lower({digits}), r'\\.?0*e', 'e')"
    exponent = f"regexp_replace({exponent}, 'e([0-9])', 'e+$1')"
    exponent = f"regexp_replace({exponent}, 'e([+-])([0-9])$', 'e$10$2')"
    return f"""CASE
      WHEN length({spelled}) < 18 AND (({size} >= 1e-3D AND {size} < 1e7D) OR {x} = 0D) THEN {spelled}
      WHEN isnan({x}) THEN 'nan'
      WHEN {size} = double('Infinity') THEN CASE WHEN {x} > 0 THEN 'inf' ELSE '-inf' END
      WHEN {size} >= 1e-4D AND {size} < 1e16D THEN {positional}
      ELSE {exponent} END"""


def as_double(x: str, dtype: T.DataType) -> str:
    """Widen a float through its text, so that 0.1f becomes 0.1 and not 0.10000000149."""
    return f"CAST(CAST({x} AS STRING) AS DOUBLE)" if isinstance(dtype, T.FloatType) else f"CAST({x} AS DOUBLE)"


def timestamp_text(x: str) -> str:
    full = f"date_format(CAST({x} AS TIMESTAMP_NTZ), 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
    return f"regexp_replace({full}, r'\\.000000$', '')"


def value_text(x: str, dtype: T.DataType) -> str:
    """Plain text of a value; NULL stays NULL."""
    kind = ty.family(dtype)
    if kind == ty.BOOLEAN:
        return f"CASE WHEN {x} THEN 'True' WHEN NOT {x} THEN 'False' END"
    if kind == ty.DATETIME and not isinstance(dtype, T.DateType):
        return timestamp_text(x)
    if kind == ty.BINARY:
        return f"coalesce(try_validate_utf8(CAST({x} AS STRING)), hex({x}))"
    if kind == ty.NESTED:
        return nested_text(x, dtype)
    if ty.is_floating(dtype):
        return float_text(as_double(x, dtype))
    return f"CAST({x} AS STRING)"


def nested_text(x: str, dtype: T.DataType) -> str:
    """Compact JSON of an array, struct or map; map entries are put in key order first."""
    if isinstance(dtype, T.MapType) and not ty.contains_map(dtype.valueType):
        x = f"array_sort(map_entries({x}))"
    return f"to_json({x})" if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)) else f"CAST({x} AS STRING)"


def present_text(x: str, dtype: T.DataType) -> str:
    return f"coalesce({value_text(x, dtype)}, '{MISSING_TEXT}')"


def quoted(x: str) -> str:
    """Quoted text: single quotes, or double quotes when the text has only single ones inside."""
    body = f"replace({x}, '\\\\', '\\\\\\\\')"
    for char in ("\\n", "\\r", "\\t"):
        body = f"replace({body}, '{char}', '\\{char}')"
    return f"""CASE WHEN contains({x}, '\\'') AND NOT contains({x}, '"') THEN concat('"', {body}, '"')
      ELSE concat('\\'', replace({body}, '\\'', '\\\\\\''), '\\'') END"""


def display(x: str, dtype: T.DataType) -> str:
    """How a report shows a value: quoted strings, tagged timestamps, plain numbers, ``None`` when missing."""
    kind = ty.family(dtype)
    if kind == ty.STRING:
        spelled = quoted(f"CAST({x} AS STRING)")
    elif isinstance(dtype, T.DateType):
        spelled = f"format_string('datetime.date(%d, %d, %d)', year({x}), month({x}), day({x}))"
    elif kind == ty.DATETIME:
        spelled = f"concat('Timestamp(\\'', {timestamp_text(x)}, '\\')')"
    elif isinstance(dtype, T.DecimalType):
        spelled = f"concat('Decimal(\\'', CAST({x} AS STRING), '\\')')"
    else:
        spelled = value_text(x, dtype)
    return f"CASE WHEN {x} IS NULL THEN '{MISSING_TEXT}' ELSE {spelled} END"


def clipped(x: str, limit: int = REPR_LIMIT) -> str:
    return f"substring({x}, 1, {limit})"


def truncated(x: str, limit: int = REPR_LIMIT) -> str:
    """Cut to ``limit`` characters, the last three being dots when something was cut."""
    return f"CASE WHEN length({x}) <= {limit} THEN {x} ELSE concat(substring({x}, 1, {limit - 3}), '...') END"


def is_ascii(x: str) -> str:
    return f"(NOT {x} RLIKE r'[^\\x00-\\x7F]')"


def drop_first_zero(x: str) -> str:
    return f"regexp_replace({x}, '^([^0]*)0', '$1')"


def drop_leading_zeros(x: str) -> str:
    return f"regexp_replace({x}, '^0+(?=.)', '')"


def colour_text(x: str) -> str:
    """Hex colours in upper case, other colour names unchanged."""
    return f"CASE WHEN startswith({x}, '#') THEN upper({x}) ELSE {x} END"


def slug(x: str) -> str:
    """A name usable inside a file name."""
    words = f"regexp_replace({x}, r'(?U)[^\\w]+', '_')"
    return f"substring(lower(btrim({words}, '_')), 1, {SLUG_LIMIT})"


def report_name(name: str) -> str:
    return name.lower().replace(" ", "_").replace("/", "_")

"""The result record: what every check returns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PASS, FAIL, SKIP, INFO = "PASS", "FAIL", "SKIP", "INFO"

RESULT_COLUMNS = ["validation", "result", "column", "pk", "detail", "source_value", "target_value"]
# Position of a row in a report: check number, place inside the check, column name, example number.
ORDER_COLUMNS = ["check_no", "part", "example"]
ALL_COLUMNS = ORDER_COLUMNS + RESULT_COLUMNS

_ARROW = pa.schema(
    [(c, pa.int32()) for c in ORDER_COLUMNS] + [(c, pa.string()) for c in RESULT_COLUMNS]
)


def text(value: object) -> Column:
    return F.lit("" if value is None else str(value))


def row_columns(
    check_no: Column | int,
    validation: Column | str,
    result: Column | str,
    *,
    part: Column | int = 0,
    example: Column | int = 0,
    column: Column | str = "",
    pk: Column | str = "",
    detail: Column | str = "",
    source_value: Column | str = "",
    target_value: Column | str = "",
) -> list[Column]:
    """One result row as select expressions; plain strings and numbers become literals."""
    values = {
        "validation": validation,
        "result": result,
        "column": column,
        "pk": pk,
        "detail": detail,
        "source_value": source_value,
        "target_value": target_value,
    }
    order = {"check_no": check_no, "part": part, "example": example}
    shaped = [(v if isinstance(v, Column) else F.lit(v)).cast("int").alias(n) for n, v in order.items()]
    return shaped + [(v if isinstance(v, Column) else F.lit(v)).cast("string").alias(n) for n, v in values.items()]


def row_sql(check_no: str | int, validation: str, result: str, **fields: str) -> list[str]:
    """One result row for ``selectExpr``; every argument is a SQL expression."""
    order = {"check_no": check_no, "part": fields.get("part", 0), "example": fields.get("example", 0)}
    texts = {"validation": validation, "result": result}
    texts |= {c: fields.get(c, "''") for c in RESULT_COLUMNS[2:]}
    return [f"CAST({x} AS INT) AS {n}" for n, x in order.items()] + [
        f"CAST({x} AS STRING) AS {n}" for n, x in texts.items()
    ]


def fixed_rows(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """Result rows known without reading data, such as schema checks; kept inside the plan."""
    records = [
        {c: r.get(c, 0) for c in ORDER_COLUMNS} | {c: str(r.get(c, "")) for c in RESULT_COLUMNS} for r in rows
    ]
    return spark.createDataFrame(pa.Table.from_pylist(records, schema=_ARROW))


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def public(rows: DataFrame) -> DataFrame:
    """The seven result columns."""
    return rows.select(*RESULT_COLUMNS)

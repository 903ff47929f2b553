"""Checks that need the two schemas only; no data is read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from twinframe.functions import types as ty
from twinframe.operators import messages as m
from twinframe.operators.results import FAIL, PASS, fixed_rows
from twinframe.plans.pair import Pair


def column_count(pair: Pair, strict: bool = False) -> DataFrame:
    left, right = set(pair.source_schema.names), set(pair.target_schema.names)
    detail = [m.COLUMN_COUNTS.format(s=len(left), t=len(right), c=len(pair.common))]
    if left - right:
        detail.append(m.SOURCE_ONLY_COLUMNS.format(names=sorted(left - right)))
    if right - left:
        detail.append(m.TARGET_ONLY_COLUMNS.format(names=sorted(right - left)))
    row = {
        "check_no": 2,
        "validation": m.COLUMN_COUNT,
        "result": FAIL if strict and left != right else PASS,
        "detail": " | ".join(detail),
        "source_value": len(left),
        "target_value": len(right),
    }
    return fixed_rows(pair.spark, [row])


def metadata_types(pair: Pair) -> DataFrame:
    rows = []
    for i, name in enumerate(pair.common):
        left, right = pair.source_schema[name].dataType, pair.target_schema[name].dataType
        fits = ty.compatible(left, right)
        names = {"s": left.simpleString(), "t": right.simpleString()}
        rows.append(
            {
                "check_no": 3,
                "part": i,
                "validation": m.METADATA_TYPE,
                "result": PASS if fits else FAIL,
                "column": name,
                "detail": (m.TYPES_COMPATIBLE if fits else m.TYPES_INCOMPATIBLE).format(**names),
                "source_value": names["s"],
                "target_value": names["t"],
            }
        )
    return fixed_rows(pair.spark, rows)


def column_order(pair: Pair) -> DataFrame:
    place = {name: i for i, name in enumerate(pair.target_schema.names)}
    rows = [
        {
            "check_no": 8,
            "part": i,
            "validation": m.COLUMN_ORDER,
            "result": FAIL,
            "column": name,
            "detail": m.ORDER_DIFFERS,
            "source_value": i,
            "target_value": place[name],
        }
        for i, name in enumerate(pair.source_schema.names)
        if place.get(name, i) != i
    ]
    passed = {"check_no": 8, "validation": m.COLUMN_ORDER, "result": PASS, "detail": m.ORDER_MATCHES}
    return fixed_rows(pair.spark, rows or [passed])


def column_specs(pair: Pair) -> DataFrame:
    """Declared lengths (char, varchar) and decimal precision and scale."""
    rows = []
    for i, name in enumerate(pair.common):
        left, right = pair.source_schema[name], pair.target_schema[name]
        differences = []
        lengths = ty.declared_length(left), ty.declared_length(right)
        if all(lengths) and lengths[0] != lengths[1]:
            differences.append((m.COLUMN_LENGTH, m.LENGTH_DIFFERS.format(c=name), *map(str, lengths)))
        specs = ty.precision_scale(left), ty.precision_scale(right)
        if all(specs) and specs[0] != specs[1]:
            shown = [f"{p},{s}" for p, s in specs]
            differences.append((m.COLUMN_PRECISION, m.PRECISION_DIFFERS.format(s=shown[0], t=shown[1]), *shown))
        for validation, detail, source_value, target_value in differences:
            rows.append(
                {
                    "check_no": 9,
                    "part": i,
                    "validation": validation,
                    "result": FAIL,
                    "column": name,
                    "detail": detail,
                    "source_value": source_value,
                    "target_value": target_value,
                }
            )
    passed = {"check_no": 9, "validation": m.COLUMN_SPECS, "result": PASS, "detail": m.SPECS_MATCH}
    return fixed_rows(pair.spark, rows or [passed])

"""Checks answered by the key table: counts, duplicates, key match and symmetric difference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.operators import messages as m
from twinframe.operators.results import FAIL, INFO, PASS, SKIP, fixed_rows, row_columns, union_all
from twinframe.plans.pair import Pair


def record_count(pair: Pair) -> DataFrame:
    stats = pair.stats
    detail = m.ROW_COUNTS.format(s=stats.source_rows, t=stats.target_rows)
    row = {
        "check_no": 1,
        "validation": m.RECORD_COUNT,
        "result": PASS if stats.source_rows == stats.target_rows else FAIL,
        "detail": detail + (m.SUBSET_NOTE if pair.subset_applied else ""),
        "source_value": stats.source_rows,
        "target_value": stats.target_rows,
    }
    return fixed_rows(pair.spark, [row])


def notes(pair: Pair) -> DataFrame | None:
    """INFO rows on what the run did to its inputs: rows removed, key columns left out."""
    rows = []
    if pair.stats.reduced:
        detail = m.SUBSET_REMOVED.format(n=pair.stats.removed_rows, side=pair.stats.reduced.capitalize())
        rows.append({"check_no": 1, "part": 1, "validation": m.RECORD_COUNT, "result": INFO, "detail": detail})
    if pair.keys and pair.keys != pair.configured_keys:
        detail = m.KEY_REDUCED.format(used=pair.keys, configured=pair.configured_keys)
        rows.append({"check_no": 7, "part": -1, "validation": m.KEY_MATCH, "result": INFO, "detail": detail})
    return fixed_rows(pair.spark, rows) if rows else None


def duplicates(pair: Pair) -> DataFrame:
    """Per side: PASS, or up to five duplicated keys in key order with their row counts."""
    if not pair.keys:
        detail = (
            m.KEY_NOT_FOUND_DUPLICATES.format(keys=pair.configured_keys)
            if pair.configured_keys
            else m.NO_KEY_DUPLICATES
        )
        row = {"check_no": 4, "validation": m.DUPLICATE, "result": SKIP, "detail": detail}
        return fixed_rows(pair.spark, [row])
    stats = pair.stats
    frames, passed = [], []
    for part, (side, count, total) in enumerate(
        (("Source", "ns", stats.source_dup_rows), ("Target", "nt", stats.target_dup_rows))
    ):
        value = f"{side.lower()}_value"
        if total == 0:
            row = {"check_no": 4, "part": part, "validation": m.DUPLICATE, "result": PASS, value: "0"}
            passed.append(row | {"detail": m.NO_DUPLICATES.format(side=side)})
            continue
        shown = (
            pair.key_table.where(F.col(count) > 1)
            .orderBy(*pair.shape.order())
            .limit(m.DUPLICATE_EXAMPLES)
            .select(
                *row_columns(
                    4,
                    m.DUPLICATE,
                    FAIL,
                    part=part,
                    pk=pair.shape.display(),
                    detail=F.format_string(m.DUPLICATES, F.lit(side), F.col(count), F.lit(total)),
                    **{value: F.col(count)},
                )
            )
        )
        frames.append(shown)
    if passed:
        frames.append(fixed_rows(pair.spark, passed))
    return union_all(frames)


def key_match(pair: Pair) -> DataFrame:
    """Summary row, then up to five keys missing on each side."""
    stats = pair.stats
    same = stats.source_only == 0 and stats.target_only == 0
    summary = {
        "check_no": 7,
        "validation": m.KEY_MATCH,
        "result": PASS if same else FAIL,
        "detail": m.KEY_COUNTS.format(c=stats.common, s=stats.source_only, t=stats.target_only),
        "source_value": stats.source_keys,
        "target_value": stats.target_keys,
    }
    frames = [fixed_rows(pair.spark, [summary])]
    if stats.source_only:
        frames.append(_one_sided(pair, 1, "nt = 0", "Source", "Target", stats.source_only))
    if stats.target_only:
        frames.append(_one_sided(pair, 2, "ns = 0", "Target", "Source", stats.target_only))
    return union_all(frames)


def _one_sided(pair: Pair, part: int, condition: str, here: str, there: str, total: int) -> DataFrame:
    present = {f"{here.lower()}_value": "EXISTS", f"{there.lower()}_value": "MISSING"}
    return (
        pair.key_table.where(condition)
        .orderBy(*pair.shape.order())
        .limit(m.KEY_EXAMPLES)
        .select(
            *row_columns(
                7,
                m.KEY_MATCH,
                FAIL,
                part=part,
                pk=pair.shape.display(),
                detail=m.KEY_ONE_SIDED.format(here=here, there=there, n=total),
                **present,
            )
        )
    )


def one_sided_keys(pair: Pair, side: str) -> DataFrame:
    """Every key that occurs on one side only, as text."""
    missing = {"source": "nt = 0", "target": "ns = 0"}[side]
    return pair.full_key_table.where(missing).select(pair.shape.display().alias("pk"))


def symmetric_difference(pair: Pair) -> DataFrame:
    if not pair.keys:
        row = {"check_no": 16, "validation": m.SYMMETRIC, "result": SKIP, "detail": m.NO_KEY}
        return fixed_rows(pair.spark, [row])
    stats = pair.stats
    total = stats.source_only + stats.target_only
    row = {
        "check_no": 16,
        "validation": m.SYMMETRIC,
        "result": PASS if total == 0 else FAIL,
        "detail": m.SYMMETRIC_COUNTS.format(n=total, s=stats.source_only, t=stats.target_only),
        "source_value": stats.source_only,
        "target_value": stats.target_only,
    }
    return fixed_rows(pair.spark, [row])

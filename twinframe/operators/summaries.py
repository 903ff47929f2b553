"""Reports over result rows: statistics, breakdowns, culprits, sign-off. All inputs are result frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.functions.text import SIGNOFF_DETAIL_LIMIT
from twinframe.operators.results import FAIL, INFO, ORDER_COLUMNS, PASS, SKIP

# Fixed value: how many columns the culprit report lists.
CULPRIT_LIMIT = 20


def _count(result: str) -> Column:
    return F.count_if(F.col("result") == result)


def _status(failed: Column) -> Column:
    return F.when(failed == 0, PASS).otherwise(FAIL)


def run_summary(results: DataFrame) -> DataFrame:
    """One row: pass, fail, skip and total counts and the overall status."""
    return results.agg(
        _count(PASS).alias("pass_count"),
        _count(FAIL).alias("fail_count"),
        _count(SKIP).alias("skip_count"),
        F.count(F.lit(1)).alias("total_count"),
    ).withColumn("status", _status(F.col("fail_count")))


def validation_breakdown(results: DataFrame) -> DataFrame:
    """One row per check with its counts by result."""
    return results.groupBy("validation").agg(
        _count(PASS).alias("passes"),
        _count(FAIL).alias("fails"),
        _count(SKIP).alias("skips"),
        _count(INFO).alias("infos"),
    )


def culprit_columns(results: DataFrame, limit: int = CULPRIT_LIMIT) -> DataFrame:
    """Columns with most failures, most first; ties by name."""
    failed = results.where((F.col("result") == FAIL) & (F.col("column") != ""))
    counts = failed.groupBy("column").agg(F.count(F.lit(1)).alias("failures"))
    return counts.orderBy(F.desc("failures"), "column").limit(limit)


def consolidated_summary(results: DataFrame) -> DataFrame:
    """One row per validation of a consolidated result frame."""
    return results.groupBy("validation_name").agg(
        _status(_count(FAIL)).alias("status"),
        _count(PASS).alias("passed"),
        _count(FAIL).alias("failed"),
        F.count(F.lit(1)).alias("total"),
    )


def signoff_summary(rows: DataFrame) -> DataFrame:
    """One row saying whether a run can be signed off, and if not why.

    The reason lists failures per check and quotes the first failing record, so ``rows`` must still carry
    the order columns.
    """
    kinds = rows.groupBy("validation").agg(
        _count(FAIL).alias("fails"),
        _count(PASS).alias("passes"),
        F.count(F.lit(1)).alias("total"),
        F.min(
            F.when(
                F.col("result") == FAIL,
                F.struct(*ORDER_COLUMNS, "column", "detail"),
            )
        ).alias("first_fail"),
    )
    # One entry per check name, so this list is as short as the list of checks.
    part = F.concat(F.col("fails").cast("string"), F.lit(" "), F.replace("validation", F.lit("_"), F.lit(" ")))
    listed = F.array_sort(F.collect_list(F.when(F.col("fails") > 0, F.struct("validation", part.alias("text")))))
    one = kinds.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("passes"), F.lit(0)).alias("passed"),
        F.coalesce(F.sum("fails"), F.lit(0)).alias("failed"),
        F.array_join(F.transform(listed, lambda x: x["text"]), ", ").alias("parts"),
        F.min("first_fail").alias("first"),
    )
    detail = F.col("first.detail")
    cut = F.when(F.length(detail) > SIGNOFF_DETAIL_LIMIT, F.concat(detail.substr(1, SIGNOFF_DETAIL_LIMIT), F.lit("…")))
    where = F.when(F.col("first.column") != "", F.concat(F.lit(' (e.g. column "'), F.col("first.column"), F.lit('")')))
    reason = F.concat(
        F.lit("Failures: "), F.col("parts"), F.coalesce(where, F.lit("")), F.lit(" — "), F.coalesce(cut, detail)
    )
    return one.select(
        _status(F.col("failed")).alias("status"),
        "total",
        "passed",
        "failed",
        F.when(F.col("failed") > 0, reason).otherwise("All validations passed — ready for sign-off.").alias("reason"),
    )

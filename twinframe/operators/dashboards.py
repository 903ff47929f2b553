"""Verdicts over tables of dashboard measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.functions.text import colour_text
from twinframe.operators.results import FAIL, PASS

# Default thresholds and what a failed measurement looks like.
FIRST_RENDER_MS = 15000.0
INTERACTION_MS = 8000.0
SIMILARITY = 0.98
FAILED_MEASUREMENT = -1


def catalog_align(
    first: DataFrame, second: DataFrame, label_first: str = "Dashboard 1", label_second: str = "Dashboard 2"
) -> DataFrame:
    """Tabs (name, index) of two dashboards matched by name regardless of case.

    Of several tabs whose names differ only in case the one with the highest index counts.
    """

    def side(df: DataFrame, mark: str) -> DataFrame:
        last = F.max(F.struct("index", "name"))
        picked = df.groupBy(F.lower("name").alias("key")).agg(last.alias("tab"))
        return picked.select("key", F.col("tab.name").alias(f"name_{mark}"), F.col("tab.index").alias(f"index_{mark}"))

    joined = side(first, "a").join(side(second, "b"), "key", "full_outer")
    reason = F.when(F.col("name_a").isNull(), f"Missing in {label_first}").when(
        F.col("name_b").isNull(), f"Missing in {label_second}"
    )
    missing = F.lit(FAILED_MEASUREMENT)
    return joined.select(
        "key",
        F.coalesce("name_a", "name_b").alias("name_a"),
        F.coalesce(F.col("index_a"), missing).alias("index_a"),
        F.coalesce("name_b", "name_a").alias("name_b"),
        F.coalesce(F.col("index_b"), missing).alias("index_b"),
        F.coalesce(reason, F.lit("")).alias("reason"),
    )


def _listed(col: Column, allowed: list[str]) -> Column:
    return F.lower(col).isin([a.lower() for a in allowed])


def _mentions(col: Column, allowed: list[str]) -> Column:
    found = F.lit(False)
    for name in allowed:
        found = found | F.contains(F.lower(col), F.lit(name.lower()))
    return found


def allowlist_violations(
    elements: DataFrame, fonts: list[str], font_sizes: list[str], colours: list[str]
) -> DataFrame:
    """One row per broken rule of an element; every input column is kept.

    A font family must mention an allowed font; sizes and hex colours must be listed. Blanks are not judged.
    """
    font, size, colour = F.col("font_family"), F.col("font_size"), F.expr(colour_text("color"))

    def rule(kind: str, broken: Column, allowed: list[str], found: Column) -> Column:
        return F.when(
            broken,
            F.struct(
                F.lit(kind).alias("violation_type"),
                F.lit(", ".join(allowed)).alias("expected"),
                found.alias("found"),
            ),
        )

    rules = F.array(
        rule("font_family", (font != "") & ~_mentions(font, fonts), fonts, font),
        rule("font_size", (size != "") & ~_listed(size, font_sizes), font_sizes, size),
        rule("color", colour.startswith("#") & ~_listed(colour, colours), colours, colour),
    )
    return elements.select("*", F.inline(rules)).where("violation_type IS NOT NULL")


def allowlist_verdict(
    elements: DataFrame, fonts: list[str], font_sizes: list[str], colours: list[str], group: str = "tab"
) -> DataFrame:
    """Violations per tab; a tab without any passes."""
    counted = allowlist_violations(elements, fonts, font_sizes, colours).groupBy(group).agg(
        F.count(F.lit(1)).alias("n")
    )
    every = elements.groupBy(group).agg(F.lit(0).cast("long").alias("n"))
    totals = counted.unionByName(every).groupBy(group).agg(F.sum("n").alias("violations"))
    return totals.withColumn("result", F.when(F.col("violations") == 0, PASS).otherwise(FAIL))


def _timing(column: str, prefix: str) -> list[Column]:
    valid = F.when(F.col(column) >= 0, F.col(column))
    return [
        F.count(valid).alias(f"{prefix}_valid"),
        F.coalesce(F.min(valid), F.lit(0.0)).alias(f"{prefix}_min"),
        F.coalesce(F.max(valid), F.lit(0.0)).alias(f"{prefix}_max"),
        F.coalesce(F.avg(valid), F.lit(0.0)).alias(f"{prefix}_avg"),
    ]


def perf_threshold(
    measurements: DataFrame, first_render_ms: float = FIRST_RENDER_MS, interaction_ms: float = INTERACTION_MS
) -> DataFrame:
    """Render and interaction times per label against thresholds; negative times are failed iterations.

    A label without any valid render time fails; without any valid interaction time it passes that part.
    """
    stats = measurements.groupBy("label").agg(
        *_timing("first_render_ms", "first_render"), *_timing("interaction_ms", "interaction")
    )
    render = (F.col("first_render_valid") > 0) & (F.col("first_render_avg") <= first_render_ms)
    interaction = (F.col("interaction_valid") == 0) | (F.col("interaction_avg") <= interaction_ms)
    return stats.withColumns(
        {
            "first_render_pass": render,
            "interaction_pass": interaction,
            "result": F.when(render & interaction, PASS).otherwise(FAIL),
        }
    )


def perf_report(measurements: DataFrame, **thresholds: float) -> DataFrame:
    """Every iteration with its label's verdict, times as whole milliseconds or ``ERROR``."""
    render = thresholds.get("first_render_ms", FIRST_RENDER_MS)
    interaction = thresholds.get("interaction_ms", INTERACTION_MS)
    verdict = perf_threshold(measurements, render, interaction)

    def shown(col: str) -> Column:
        return F.when(F.col(col) >= 0, F.bround(F.col(col), 0).cast("long").cast("string")).otherwise("ERROR")

    # One verdict row per label; Spark broadcasts it when it is small.
    return measurements.join(verdict, "label").select(
        F.col("label").alias("dashboard_label"),
        F.col("url").alias("dashboard_url"),
        "iteration",
        shown("first_render_ms").alias("first_render_ms"),
        shown("interaction_ms").alias("interaction_ms"),
        F.lit(f"{render:.0f}").alias("first_render_threshold_ms"),
        F.lit(f"{interaction:.0f}").alias("interaction_threshold_ms"),
        F.bround("first_render_avg", 0).cast("long").cast("string").alias("first_render_avg_ms"),
        F.bround("interaction_avg", 0).cast("long").cast("string").alias("interaction_avg_ms"),
        "first_render_pass",
        "interaction_pass",
        (F.col("result") == PASS).alias("overall_pass"),
    )


def similarity_verdicts(scores: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Each comparison with its verdict; a missing score counts as 0."""
    scored = scores.withColumn("ssim_score", F.coalesce(F.col("ssim_score"), F.lit(0.0)))
    return scored.withColumn("result", F.when(F.col("ssim_score") >= threshold, PASS).otherwise(FAIL))


def diff_score_summary(scores: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Per scenario: passed, failed and the mean of the scores above 0 to four places."""
    passed = F.col("result") == PASS
    return (
        similarity_verdicts(scores, threshold)
        .groupBy("scenario_label")
        .agg(
            F.count_if(passed).alias("passed"),
            F.count_if(~passed).alias("failed"),
            F.count(F.lit(1)).alias("total"),
            F.round(F.avg(F.when(F.col("ssim_score") > 0, F.col("ssim_score"))), 4).alias("avg_score"),
        )
    )

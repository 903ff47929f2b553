"""Metadata-only comparison: row and column counts per source and target."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.operators.results import union_all
from twinframe.session import stage
from twinframe.sources.registry import load_source
from twinframe.spec import ValidationSpec

METADATA_COLUMNS = [
    "name",
    "csv_file",
    "csv_rows",
    "csv_cols",
    "table",
    "table_rows",
    "table_cols",
    "rows_match",
    "cols_match",
    "status",
]


def _counted(df: DataFrame | None, place: int, side: str, spark: SparkSession) -> DataFrame:
    """One row: which side of which validation, its rows and columns; NULL where it cannot be read."""
    if df is None:
        counted = spark.range(1).select(F.lit(None).cast("long").alias("rows"), F.lit(None).cast("long").alias("cols"))
    else:
        counted = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("cols", F.lit(len(df.columns)).cast("long"))
    return counted.select(F.lit(place).alias("place"), F.lit(side).alias("side"), "rows", "cols")


def compare_counts(
    spark: SparkSession, pairs: list[tuple[str, str, DataFrame | None, str, DataFrame | None]]
) -> DataFrame:
    """Rows (name, source label, source, target label, target) turned into verdicts, counted in one job."""
    frames = []
    for place, (_, _, source, _, target) in enumerate(pairs):
        frames.append(_counted(source, place, "s", spark))
        frames.append(_counted(target, place, "t", spark))

    def of(side: str, col: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(col))).alias(f"{side}_{col}")

    counts = union_all(frames).groupBy("place").agg(*[of(s, c) for s in ("s", "t") for c in ("rows", "cols")])

    def label(index: int) -> Column:
        return F.get(F.array(*[F.lit(p[index]) for p in pairs]), F.col("place"))

    no_source, no_target = F.col("s_rows").isNull(), F.col("t_rows").isNull()

    def shown(side: str, col: str) -> Column:
        text = F.coalesce(F.col(f"{side}_{col}").cast("string"), F.lit("ERROR"))
        return F.when(no_source, "N/A").otherwise(text) if side == "t" else text

    def match(col: str) -> Column:
        equal = F.col(f"s_{col}") == F.col(f"t_{col}")
        return F.when(no_source | no_target, "ERROR").when(equal, "YES").otherwise("NO")

    same = (F.col("s_rows") == F.col("t_rows")) & (F.col("s_cols") == F.col("t_cols"))
    return counts.select(
        label(0).alias("name"),
        label(1).alias("csv_file"),
        shown("s", "rows").alias("csv_rows"),
        shown("s", "cols").alias("csv_cols"),
        label(3).alias("table"),
        shown("t", "rows").alias("table_rows"),
        shown("t", "cols").alias("table_cols"),
        match("rows").alias("rows_match"),
        match("cols").alias("cols_match"),
        F.when(same, "PASSED").otherwise("FAILED").alias("status"),
    )


def metadata_compare(spark: SparkSession, specs: list[ValidationSpec]) -> DataFrame:
    """Compare the counts of every spec's sides; a side that cannot be opened or read becomes an ERROR row."""

    def opened(config: dict) -> DataFrame | None:
        try:
            return load_source(spark, config)
        except (PySparkException, ValueError, OSError, KeyError):
            return None

    pairs = [
        (
            spec.name,
            str(spec.source.get("path", spec.source.get("table", ""))),
            opened(spec.source),
            str(spec.target.get("table", spec.target.get("path", ""))),
            opened(spec.target),
        )
        for spec in specs
    ]
    try:
        return stage(compare_counts(spark, pairs), "metadata")
    except PySparkException:  # a side that opens may still fail while it is read: then find out which
        read = [(name, a, _readable(source), b, _readable(target)) for name, a, source, b, target in pairs]
        return stage(compare_counts(spark, read), "metadata")


def _readable(df: DataFrame | None) -> DataFrame | None:
    try:
        if df is not None:
            df.count()
        return df
    except PySparkException:
        return None

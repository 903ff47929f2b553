"""Writing result rows."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from twinframe.functions.text import report_name

# Fixed value: the time stamp in a result's name.
STAMP_FORMAT = "%Y%m%d_%H%M%S"


def result_path(folder: str, name: str, fmt: str = "csv", stamp: str | None = None) -> str:
    stamp = stamp or datetime.now(timezone.utc).strftime(STAMP_FORMAT)
    return f"{folder.rstrip('/')}/{report_name(name)}_{stamp}.{fmt}"


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """CSV with header and minimal quoting, or Parquet. CSV has no null, so nulls are written as empty cells."""
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer.options(header=True, quote='"', escape='"', emptyValue="", nullValue="").csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"Unsupported result format: {fmt}")
    return path


def write_results(df: DataFrame, folder: str, name: str, fmt: str = "csv", stamp: str | None = None) -> str:
    return write_table(df, result_path(folder, name, fmt, stamp), fmt)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result rows from a CSV sink; empty cells are empty texts again."""
    df = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(path)
    return df.na.fill("")


def append_results(df: DataFrame, path: str, run_id: str) -> str:
    """Add a run to a Parquet table of results, one partition per run."""
    from pyspark.sql import functions as F

    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)
    return path

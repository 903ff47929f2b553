"""Reading members of zip files inside Spark tasks; one task handles one file at a time."""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Iterator
from io import BytesIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 4096


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``content`` of every file under ``path``."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def rows_of_archives(
    files: DataFrame, read: Callable[[str, zipfile.ZipFile], Iterator[tuple]], schema: str, columns: list[str]
) -> DataFrame:
    """Apply ``read`` to every archive; its tuples are handed to Spark in batches of bounded size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(BytesIO(content)) as archive:
                    for row in read(path, archive):
                        rows.append(row)
                        if len(rows) >= BATCH_ROWS:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, schema)


def table_of_rows(rows: DataFrame) -> DataFrame:
    """Rows with ``header`` and ``cells`` as a table; a file without some column has nulls there."""
    layouts = rows.select("header").distinct().collect()  # as many as there are different headers
    names = list(dict.fromkeys(n for r in layouts for n in r.header if n is not None))
    return rows.select(
        *[F.get("cells", F.array_position("header", F.lit(n)).cast("int") - 1).alias(n) for n in names]
    )

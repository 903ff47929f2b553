"""Source types and how a configuration becomes a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.functions.text import ident
from twinframe.operators.align import lower_columns
from twinframe.operators.sampling import limited
from twinframe.spec import positive_int

Loader = Callable[[SparkSession, dict[str, Any]], DataFrame]

_loaders: dict[str, Loader] = {}


def register_source(kind: str, loader: Loader) -> None:
    """Make ``type: kind`` available in configurations."""
    _loaders[kind.lower()] = loader


def project(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """Keep the listed columns, in the table's own order; names compare without case."""
    if not columns:
        return df
    wanted = {c.lower() for c in columns}
    return df.select(*[F.col(ident(c)) for c in df.columns if c.lower() in wanted])


def load_source(spark: SparkSession, config: dict[str, Any], order_by: list[str] | None = None) -> DataFrame:
    """Open a source lazily: lower-case column names, chosen columns, optional row limit."""
    kind = str(config.get("type", "")).lower()
    if kind not in _loaders:
        raise ValueError(f"Unknown source type '{kind}'. Known types: {sorted(_loaders)}")
    df = lower_columns(project(_loaders[kind](spark, config), config.get("columns")))
    limit = positive_int(config.get("limit", config.get("row_limit")), "'limit'")
    if limit is None:
        return df
    order = [c for c in order_by or [] if c in df.columns]
    return limited(df, limit, order if order and len(order) == len(order_by or []) else None)


def is_columnar(config: dict[str, Any]) -> bool:
    """Whether a source reads single columns cheaply and alike each time: Parquet files and catalog tables."""
    kind = str(config.get("type", "")).lower()
    if kind == "file":
        return str(config.get("format") or "").lower() == "parquet" or str(config.get("path", "")).rstrip("/").endswith(".parquet")
    from twinframe.sources.tables import is_jdbc

    return kind == "table" and not is_jdbc(config)


def _register_builtin() -> None:
    from twinframe.sources import files, tables, workbook

    register_source("file", files.load_file)
    register_source("table", tables.load_table)
    register_source("datasource", workbook.load_workbook)


_register_builtin()

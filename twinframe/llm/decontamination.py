"""Benchmark items inside documents: size-partitioned MinHash containment search, verified on exact shingles.

See ``windows`` for the method and for nulls, short texts and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.llm.windows import THRESHOLD, found_items, search_sql
from twinframe.session import stage


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``id_col``, ``item_col``, ``containment`` and ``first_word`` of every benchmark item found in a document."""
    found = found_items(docs, benchmark, id_col, text_col, item_col, item_text_col, threshold)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "containment", "first_word")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item, columns as they were. Rows are told apart by a key of their own, so a
    clean row stays whatever row shares its id."""
    keyed = stage(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    bad = contaminated(keyed, benchmark, "__row", text_col, **options).select("__row").distinct()
    return keyed.join(bad, "__row", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def oracle_sql() -> str:
    found = search_sql("SELECT item_id AS item, coalesce(text, '') AS t FROM benchmark")
    return f"SELECT id AS doc_id, item AS item_id, containment, first_word FROM ({found})"

"""A training-data pipeline over ``documents``: stages of one operator each, every stage on all that its predecessor kept.

Each stage is written as Parquet to the shared folder and read again as the documents of the next. What a stage has left
in the shared folder, but for its rows, is deleted when these are written, and so are the rows that it read.
"""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import twinframe
from twinframe.llm import queries
from twinframe.session import named_paths, release, scratch_path

# Tasks carry this code with them, so Python workers need not have it on their path.
cloudpickle.register_pickle_by_value(twinframe)

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", queries.keep_good),
    ("n-gram Jaccard join", queries.keep_one_of_each),
    ("benchmark decontamination", queries.drop_contaminated),
    ("PII", queries.hide_private),
    ("best-fit packing", queries.pack),
]

#: Model training, MinHash and a keyed permutation have no SQL form; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    earlier = named_paths()
    for name, step in STAGES:
        rows = step(spark, docs, sf_dir)
        path = scratch_path(spark, name.replace(" ", "-"))
        rows.write.parquet(path)
        docs = spark.read.schema(rows.schema).parquet(path)
        del rows
        release(spark, [p for p in named_paths(earlier) if p != path])
        _forget(spark)
    return docs


def _forget(spark: SparkSession) -> None:
    """Let the driver collect plans of the finished stage; Spark then frees their shuffles and broadcasts everywhere."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()

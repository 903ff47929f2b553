"""The first n rows of an order without bringing them into one task.

Spark's own ``orderBy.limit`` merges the first n rows of every task in a single one, which is fine for a report and not for
half a table. Beyond ``FEW`` rows the distinct order keys are counted and split into ranges instead: the counts of the
ranges tell the range that holds the n-th row, a running sum inside it the key there. All rows before that key are kept by a
filter that moves no row; of the rows that share it as many as still fit are kept, by their position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinframe.functions.text import ident
from twinframe.operators.ordinal import POSITION, with_position
from twinframe.session import stage

#: Rows up to which one task may merge the first rows of all tasks.
FEW = 10_000


def first_rows(df: DataFrame, order: list[Column], n: int, few: int = FEW) -> DataFrame:
    """The first ``n`` rows by the columns ``order`` (ascending, nulls first); rows that tie are taken by position.

    Fewer rows than ``n`` are all kept. ``df`` is read up to three times and has to give the same rows each time.
    """
    if n <= few:
        return (df.orderBy(*order) if order else df).limit(n)
    if not order:
        return _first_positions(df, n)
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    cut = _cut(df.select(key.alias("key")), n)
    if cut is None:
        return df
    cut_row, room, ties = cut
    at = cut_row.select("key").scalar()
    if room == ties:
        return df.where(key <= at)
    return df.where(key < at).unionByName(_first_positions(df.where(key == at), room))


def _first_positions(df: DataFrame, n: int) -> DataFrame:
    columns = [F.col(ident(c)) for c in df.columns]
    return with_position(df).where(F.col(POSITION) < n).select(*columns)


def _cut(keys: DataFrame, n: int) -> tuple[DataFrame, int, int] | None:
    """The key of the n-th row as a frame of one row, how many of its rows are among the first n, and how many it has.

    None where there are no more than n rows. Rows of one key are counted together before they move, so a key that holds
    most rows is one row here; one number per range comes to the driver.
    """
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    ranged = stage(counts.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "cut")
    before = 0
    for r in ranged.groupBy("part").agg(F.sum("rows").alias("rows")).orderBy("part").collect():
        if before + r["rows"] > n:
            break
        before += r["rows"]
    else:
        return None
    if before == n:  # the cut lies between two ranges
        last = ranged.where(F.col("part") < r["part"]).agg(F.max("key").alias("key"))
        return last, 1, 1
    running = F.sum("rows").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    here = ranged.where(F.col("part") == r["part"]).withColumn("upto", running + before)
    last = stage(here.where(F.col("upto") >= n).orderBy("key").limit(1), "cut-key")
    row = last.select("rows", "upto").first()
    return last, n - (row["upto"] - row["rows"]), row["rows"]

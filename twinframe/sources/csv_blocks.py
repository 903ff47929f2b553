"""Records of CSV files whose quoted cells hold line breaks, read in splits.

Files are read as lines by any number of tasks. Whether a line ends inside a quoted cell is told for either beginning,
outside or inside of one: a line may keep the state, change it, or lead to one state from both. What is known of the lines
before it composes to the state at each line: that of the last line that leads to one state, changed as often as lines
since then change it. This is composed inside each block of a file and then over its blocks; lines that begin outside of a
quoted cell begin records, and the lines of a record are put together.

A quote opens a cell only as its first character; anywhere else in a cell that is not quoted it is text, as for the reader.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from twinframe.session import stage

_BEFORE, _SO_FAR = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)


def _in_block() -> WindowSpec:
    return Window.partitionBy("file", "block").orderBy("at")


def _in_file() -> WindowSpec:
    return Window.partitionBy("file").orderBy("block")


def _open(line: Column, sep: str) -> Column:
    """1 if the line, begun outside of quoted cells, ends inside of one."""
    mark = re.escape(sep)
    cells = rf'^(?:(?:"(?:[^"]++|"")*+"[^{mark}]*+|[^"{mark}][^{mark}]*+|){mark})*+'
    return F.regexp_replace(line, cells, "").rlike(r'^"(?:[^"]++|"")*+\z').cast("int")


def lines(spark: SparkSession, path: str | list[str], sep: str, charset: str) -> DataFrame:
    """``value``, its place (``file``, ``block``, ``at`` rising inside a block), and the states it leads to from either."""
    rows = spark.read.text(path, lineSep="\n").withColumns({"file": "_metadata.file_path", "block": "_metadata.file_block_start"})
    text = F.col("value") if charset == "UTF-8" else F.decode(F.col("value").cast("binary"), charset)
    placed = rows.select("file", "block", F.monotonically_increasing_id().alias("at"), text.alias("value"))
    return placed.withColumns({"out0": _open(F.col("value"), sep), "out1": _open(F.concat(F.lit('"'), "value"), sep)})


def _composed(rows: DataFrame, order: WindowSpec, out0: str, out1: str) -> DataFrame:
    """Rows with ``before0`` and ``before1``: the state before each, if all rows of its window begin outside or inside."""
    fixed = F.col(out0) == F.col(out1)
    turns = F.when(~fixed & (F.col(out0) == 1), 1).otherwise(0)
    counted = rows.withColumns({"turned": F.sum(turns).over(order.rowsBetween(*_SO_FAR)), "own": turns})
    known = counted.withColumn("known", F.when(fixed, (F.col(out0) + F.col("turned")) % 2))
    last = F.last("known", ignorenulls=True).over(order.rowsBetween(*_BEFORE))
    earlier = F.col("turned") - F.col("own")
    states = {f"before{k}": (F.coalesce(last, F.lit(k)) + earlier) % 2 for k in (0, 1)}
    return known.withColumns(states).drop("turned", "own", "known")


def _after(state: str, out0: str = "out0", out1: str = "out1") -> Column:
    return F.when(F.col(state) == 0, F.col(out0)).otherwise(F.col(out1))


def records(spark: SparkSession, path: str | list[str], sep: str, charset: str) -> DataFrame | None:
    """``file``, ``record`` (number of the record in its file, the header is 1) and ``value``, ordered by range and inside
    partitions. Empty lines are left out. A file that ends inside a quoted cell is an error. None if some line holds a bare
    carriage return, which the reader may take for the end of a line."""
    staged = stage(lines(spark, path, sep, charset), "csv-lines")
    bare = F.regexp_replace("value", "\r$", "").contains("\r")
    if staged.agg(F.coalesce(F.bool_or(bare), F.lit(False))).first()[0]:
        return None
    # the last line of a block tells what the block leads to
    inner = _composed(staged, _in_block(), "out0", "out1")
    starts = [F.count_if((F.col(f"before{k}") == 0) & (F.col("value") != "") & (F.col("value") != "\r")) for k in (0, 1)]
    ends = [F.max_by(_after(f"before{k}"), "at") for k in (0, 1)]
    blocks = inner.groupBy("file", "block").agg(
        *(c.alias(n) for c, n in zip([*ends, *starts], ["block0", "block1", "starts0", "starts1"]))
    )
    states = _composed(blocks, _in_file(), "block0", "block1").withColumnRenamed("before0", "start")
    begun = F.when(F.col("start") == 0, F.col("starts0")).otherwise(F.col("starts1"))
    offsets = states.select(
        "file",
        "block",
        "start",
        F.coalesce(F.sum(begun).over(_in_file().rowsBetween(*_BEFORE)), F.lit(0)).alias("earlier"),
        (F.lead("block").over(_in_file()).isNull() & (_after("start", "block0", "block1") == 1)).alias("left_open"),
    )
    message = F.concat(F.lit("A quoted cell is open at the end of "), "file")
    sound = offsets.where(F.when(F.col("left_open"), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).drop("left_open")
    known = inner.join(sound, ["file", "block"])
    outside = F.when(F.col("start") == 0, F.col("before0")).otherwise(F.col("before1")) == 0
    empty = F.col("value").isin("", "\r")
    kept = known.withColumn("begins", outside & ~empty).where(~(outside & empty))
    record = F.col("earlier") + F.coalesce(F.sum(F.col("begins").cast("int")).over(_in_block().rowsBetween(*_SO_FAR)), F.lit(0))
    numbered = kept.select("file", record.alias("record"), "block", "at", "value")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("block", "at", "value"))), lambda p: p["value"])
    whole = numbered.repartitionByRange("file", "record").groupBy("file", "record").agg(F.array_join(parts, "\n").alias("value"))
    return whole.withColumn("value", F.regexp_replace("value", "\r$", "")).sortWithinPartitions("file", "record")

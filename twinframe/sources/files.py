"""File sources: CSV, JSON in four layouts, Parquet and Excel workbooks."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.functions.text import ident
from twinframe.session import named_paths, release, stage
from twinframe.sources import encoding as enc
from twinframe.sources import csv_blocks, json_blocks, xlsx

# Format by file suffix. Other suffixes need an explicit ``format``.
FORMATS = {".csv": "csv", ".json": "json", ".parquet": "parquet", ".xlsx": "excel"}
ORIENTS = ("records", "index", "columns", "values")
_CORRUPT = "_corrupt_record"
_PLACE = ("_file_of_row", "_split_of_row", "_place_of_row")
_CELLS = "map<string, map<string, string>>"


def detect_format(path: str) -> str:
    found = re.search(r"\.[^./\\]+$", path.rstrip("/"))
    suffix = found.group(0).lower() if found else ""
    if suffix not in FORMATS:
        raise ValueError(f"Unsupported file extension: {suffix}. Supported: {sorted(FORMATS)}")
    return FORMATS[suffix]


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.globStatus(jvm_path)
    return found is not None and len(found) > 0


def load_file(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    path = config["path"]
    kind = str(config.get("format") or detect_format(path)).lower()
    if not path_exists(spark, path):
        raise FileNotFoundError(f"File not found: {path}")
    if kind == "csv":
        return read_csv(spark, path, config.get("sep", ","), config.get("encoding"), config.get("multiline", "auto"))
    if kind == "json":
        return read_json(spark, path, config.get("json_orient", "records"))
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "excel":
        return xlsx.read_xlsx(spark, path, config.get("sheet_name", 0))
    raise ValueError(f"Unsupported format: {kind}")


def read_csv(
    spark: SparkSession, path: str, sep: str = ",", encoding: str | None = None, multiline: bool | str = "auto"
) -> DataFrame:
    """Every cell as text; only empty cells are null. A line with more cells than the header is an error.

    ``multiline`` says whether quoted cells hold line breaks. Records of files with such cells are put together from lines
    and written once to the shared folder, so ``auto`` looks for them; that pass also finds the encoding. Naming both saves
    it, but then all files must have one header. Only UTF-16, separators of several characters and lines that end in bare
    carriage returns are left to one task a file. Files of a folder that differ in encoding, such cells or header are read apart and brought together
    by column name; differing column sets are an error.
    """
    earlier = named_paths()
    facts = enc.text_facts(spark, path) if encoding is None or multiline == "auto" else []
    parts = []
    for fact in facts or [None]:
        name = encoding or (enc.encoding_from(fact) if fact else enc.UTF8)
        whole = bool(fact and fact.open_quotes) if multiline == "auto" else bool(multiline)
        paths = path if len(facts) < 2 else [unquote(f) for f in fact.files]
        parts.append((paths, _read_alike(spark, paths, sep, name, whole, placed=len(facts) > 1)))
    first = parts[0][1]
    for paths, part in parts[1:]:
        if sorted(part.columns) != sorted(first.columns):
            raise ValueError(f"Columns {part.columns} of {paths[0]} are not those of {parts[0][0][0]}: {first.columns}")
    if len(parts) == 1:
        release(spark, named_paths(earlier)[:-1])  # the last one has the rows
        return first
    # a union has no row order of its own: rows are written once by file, split and place, which numbers them for good
    union = reduce(DataFrame.unionByName, [part for _, part in parts])
    ordered = union.orderBy(*(F.col(ident(c)) for c in _PLACE))
    rows = stage(ordered.drop(*_PLACE), "csv-folder")
    release(spark, named_paths(earlier)[:-1])
    return rows


def _read_alike(spark: SparkSession, path: str | list[str], sep: str, name: str, whole: bool, placed: bool = False) -> DataFrame:
    """CSV files of one header and encoding; ``whole``: some quoted cell holds a line break; ``placed``: with the file, the
    split and the place in it of every row."""
    charset = enc.spark_charset(name)
    whole = whole or charset.startswith("UTF-16")
    options = {
        "header": True,
        "sep": sep,
        "encoding": charset,
        "quote": '"',
        "escape": '"',
        "multiLine": whole,
        "mode": "PERMISSIVE",
        "nullValue": "",
        # Lines are parsed whole either way, and only a full parse notices surplus cells.
        "columnPruning": False,
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
    }
    columns = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, _CORRUPT]])
    options["columnNameOfCorruptRecord"] = _CORRUPT
    splits = whole and len(sep) == 1 and not charset.startswith("UTF-16")
    records = csv_blocks.records(spark, path, sep, charset) if splits else None
    if records is not None:
        return _from_records(records, schema, options, name, placed)
    df = spark.read.options(**options).schema(schema).csv(path)
    hidden = []
    if placed:
        places = ("_metadata.file_path", "_metadata.file_block_start")
        df = df.select("*", *(F.col(p).alias(c) for p, c in zip(places, _PLACE))).withColumn(_PLACE[2], F.monotonically_increasing_id())
        hidden = list(_PLACE)
    return enc.restore_cp1252(_reject_surplus(df, columns, sep, hidden), name, hidden)


def _from_records(records: DataFrame, schema: T.StructType, options: dict[str, Any], name: str, placed: bool) -> DataFrame:
    """Rows of ``csv_blocks.records`` without headers; written in their order, unless they go to the rows of other files."""
    texts = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if k not in ("header", "encoding")}
    places = (F.col("file"), F.col("record"), F.lit(0).cast("long"))
    parsed = records.where("record > 1").select(F.from_csv("value", schema.toDDL(), texts).alias("r"), *(p.alias(c) for p, c in zip(places, _PLACE)))
    hidden = list(_PLACE) if placed else []
    df = parsed.select("r.*", *(F.col(c) for c in hidden))
    columns = [f.name for f in schema.fields if f.name != _CORRUPT]
    rows = enc.restore_cp1252(_reject_surplus(df, columns, options["sep"], hidden), name, hidden)
    return rows if placed else stage(rows, "csv-records")


def _reject_surplus(df: DataFrame, columns: list[str], sep: str, hidden: list[str]) -> DataFrame:
    """Short lines are padded with nulls; a line with surplus cells stops the read when it is reached."""
    unquoted = F.regexp_replace(_CORRUPT, '"[^"]*"', "")
    separators = (F.length(unquoted) - F.length(F.replace(unquoted, F.lit(sep), F.lit("")))) / len(sep)
    surplus = F.coalesce(separators >= len(columns), F.lit(False))
    # The first column is named in the message because Spark rejects reads of the corrupt record alone.
    message = F.concat(
        F.lit(f"Expected {len(columns)} fields in line: "),
        F.coalesce(F.col(_CORRUPT), F.col(ident(columns[0])), F.lit("")),
    )
    checked = df.where(F.when(surplus, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    return checked.select(*[F.col(ident(c)) for c in [*columns, *hidden]])


def read_json(spark: SparkSession, path: str, orient: str = "records") -> DataFrame:
    if orient not in ORIENTS:
        raise ValueError(f"Unsupported json_orient: {orient}. Supported: {ORIENTS}")
    if orient == "records":
        return _records(spark, path)
    documents = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")
    )
    return json_table(documents, orient)


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Objects with their columns in the order of the first object of the first file; what is no JSON is an error.

    Objects may stand on lines of their own, follow each other in any other way or be the items of one array; files are
    read in splits whichever it is. Files that are not in UTF-8 hold one object or array and are read by a task each.
    """
    try:
        lines = json_blocks.object_lines(spark, path)
        reader = spark.read.options(mode="FAILFAST", multiLine=lines is None)
        df = reader.json(path if lines is None else lines)
    except (Py4JJavaError, PySparkException) as error:  # raised while objects or columns are looked for
        raise ValueError(f"Not JSON of the expected layout: {path}") from error
    files = sorted(map(unquote, df.inputFiles()))
    order = {}
    if files:  # the parser of keys stops behind the first object
        text = spark.read.text(files[0], wholetext=lines is None).where("value rlike '[{]'")
        head = text.select(F.regexp_extract("value", r"(?s)^[^{]*(\{.*)", 1).alias("value"))
        row = head.select(F.expr("json_object_keys(value)").alias("keys")).first()
        order = {k: i for i, k in enumerate((row and row["keys"]) or [])}
    return df.select(*[F.col(ident(c)) for c in sorted(df.columns, key=lambda c: order.get(c, len(order)))])


def _parsed(documents: DataFrame, schema: str) -> DataFrame:
    """``path`` and ``parsed``; a document that is not of the layout stops the read with its path."""
    parsed = F.from_json("content", schema)
    message = F.concat(F.lit("Not JSON of the expected layout: "), F.col("path"))
    bad = parsed.isNull() & (F.trim("content") != "")
    return documents.select("path", F.when(bad, F.raise_error(message).cast(schema)).otherwise(parsed).alias("parsed"))


def json_table(documents: DataFrame, orient: str) -> DataFrame:
    """Rows of JSON documents (``path``, ``content``) laid out by index, by column or as bare rows.

    All cells come out as text. One document is read by one task, which the layout forces.
    """
    return {"index": _from_index, "columns": _from_columns, "values": _from_values}[orient](documents)


def _names(cells: DataFrame) -> list[str]:
    """Column names by first appearance; as many values as there are columns."""
    rows = cells.groupBy("column").agg(F.min("place").alias("place")).orderBy("place", "column").collect()
    return [r["column"] for r in rows]


def _from_index(documents: DataFrame) -> DataFrame:
    rows = _parsed(documents, _CELLS).select("path", F.explode("parsed").alias("row_key", "cells"))
    names = _names(rows.select(F.posexplode(F.map_keys("cells")).alias("place", "column")))
    return rows.select(*[F.col("cells")[n].alias(n) for n in names])


def _from_columns(documents: DataFrame) -> DataFrame:
    columns = _parsed(documents, _CELLS).select("path", F.posexplode("parsed").alias("place", "column", "cells"))
    names = _names(columns)
    cells = columns.select("path", "column", F.explode("cells").alias("row_key", "value"))
    # A cell is alone in its (path, row, column), so the aggregate only lines cells up.
    picked = [F.any_value(F.when(F.col("column") == n, F.col("value")), ignoreNulls=True).alias(n) for n in names]
    return cells.groupBy("path", "row_key").agg(*picked).select(*[F.col(ident(n)) for n in names])


def _from_values(documents: DataFrame) -> DataFrame:
    rows = _parsed(documents, "array<array<string>>").select(F.explode("parsed").alias("cells"))
    width = rows.agg(F.coalesce(F.max(F.size("cells")), F.lit(0)).alias("n")).first().n
    return rows.select(*[F.get("cells", F.lit(i)).alias(str(i)) for i in range(width)])

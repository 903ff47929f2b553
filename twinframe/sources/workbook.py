"""Packaged dashboard workbooks (``.twbx``) as Spark sources: embedded text data and the column catalog."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.functions.text import ident
from twinframe.sources.archives import binary_files, rows_of_archives, table_of_rows

# Embedded text members, built-in datasources that are left out, least similarity of a name match.
TEXT_SUFFIXES = (".csv", ".tsv", ".txt")
EXTRACT_SUFFIXES = (".hyper", ".tde")
BUILTIN_DATASOURCES = ("Parameters", "Sample - Superstore")
LEAST_SIMILARITY = 0.5

CATALOG_COLUMNS = ["datasource_name", "column_name", "datatype", "raw_name"]


def _layout(archive: zipfile.ZipFile) -> ElementTree.Element | None:
    member = next((n for n in archive.namelist() if n.endswith(".twb")), None)
    return ElementTree.fromstring(archive.read(member)) if member else None


def _datasources(root: ElementTree.Element) -> Iterator[tuple[str, ElementTree.Element]]:
    found = [d for d in root.iter("datasource") if d.get("name", "") not in BUILTIN_DATASOURCES]
    for place, element in enumerate(found):
        yield element.get("caption", element.get("name", f"Datasource_{place}")), element


def _records(element: ElementTree.Element) -> Iterator[tuple[str, str, str]]:
    for record in element.iter("metadata-record"):
        raw = record.findtext(".//local-name")
        if raw and not raw.strip("[]").startswith("System"):
            yield raw.strip("[]"), record.findtext(".//local-type") or "unknown", raw


def _column_elements(element: ElementTree.Element) -> Iterator[tuple[str, str, str]]:
    for column in element.iter("column"):
        raw = column.get("name", column.get("caption", ""))
        if raw and not raw.startswith("[System"):
            yield raw.strip("[]"), column.get("datatype", "unknown"), raw


def _bracketed_names(element: ElementTree.Element) -> Iterator[tuple[str, str, str]]:
    seen = set()
    for item in element.iter():
        raw = item.get("name", "")
        if raw.startswith("[") and not raw.startswith("[System") and raw.strip("[]") not in seen:
            seen.add(raw.strip("[]"))
            yield raw.strip("[]"), item.get("datatype", item.get("type", "unknown")), raw


def _catalog_rows(path: str, archive: zipfile.ZipFile) -> Iterator[tuple]:
    """Columns of each datasource, from the first description the workbook offers."""
    root = _layout(archive)
    if root is None:
        return
    named = dict(_datasources(root))  # the last datasource of a name counts
    for place, (name, element) in enumerate(named.items()):
        for describe in (_records, _column_elements, _bracketed_names):
            columns = {c: (t, raw) for c, t, raw in describe(element) if c}
            if columns:
                break
        for column, (datatype, raw) in columns.items():
            yield path, place, name, column, datatype, raw


def workbook_catalog(files: DataFrame) -> DataFrame:
    """One row per datasource column of every workbook in ``files`` (path, content)."""
    return rows_of_archives(
        files,
        _catalog_rows,
        "path string, place int, datasource_name string, column_name string, datatype string, raw_name string",
        ["path", "place", *CATALOG_COLUMNS],
    )


def _profile_rows(path: str, archive: zipfile.ZipFile) -> Iterator[tuple]:
    names, root = archive.namelist(), _layout(archive)
    text = any(n.endswith(TEXT_SUFFIXES) for n in names)
    extract = any(n.endswith(EXTRACT_SUFFIXES) for n in names)
    counts = [0, 0, 0]
    title = "Unknown"
    if root is not None:
        title = root.get("name", "Unknown")
        counts = [len(dict(_datasources(root))), len(root.findall(".//worksheet")), len(root.findall(".//dashboard"))]
    yield path, title, *counts, text or extract, "csv" if text else "metadata"


def workbook_profile(files: DataFrame) -> DataFrame:
    """One row per workbook: datasources, worksheets, dashboards, and what data it can be read from."""
    return rows_of_archives(
        files,
        _profile_rows,
        "path string, workbook_name string, datasource_count int, worksheet_count int, dashboard_count int, "
        "has_embedded_data boolean, data_source_type string",
        [
            "path",
            "workbook_name",
            "datasource_count",
            "worksheet_count",
            "dashboard_count",
            "has_embedded_data",
            "data_source_type",
        ],
    )


def _text_member(archive: zipfile.ZipFile) -> str | None:
    return next((n for n in archive.namelist() if n.endswith(TEXT_SUFFIXES)), None)


def _uneven(lines: Iterator[list[str]]) -> bool:
    """True when a line has more cells than the header: the separator was wrong."""
    header = next(lines, [])
    return any(len(line) > len(header) for line in lines)


def _embedded_rows(path: str, archive: zipfile.ZipFile) -> Iterator[tuple]:
    """Header and cells of the first text member; comma separated, or by tab where commas do not fit."""
    member = _text_member(archive)
    if member is None:
        return

    def lines(separator: str) -> Iterator[list[str]]:
        with archive.open(member) as raw:
            reader = csv.reader(io.TextIOWrapper(raw, "utf-8-sig", newline=""), delimiter=separator)
            yield from (line for line in reader if line)

    content = lines("\t" if _uneven(lines(",")) else ",")
    header = [h.lower() for h in next(content, [])]
    for number, cells in enumerate(content):
        padded = [c or None for c in cells] + [None] * (len(header) - len(cells))
        yield path, number, header, padded[: len(header)]


def workbook_rows(files: DataFrame) -> DataFrame:
    """Embedded rows of every workbook: path, row_no, header, cells."""
    return rows_of_archives(
        files,
        _embedded_rows,
        "path string, row_no int, header array<string>, cells array<string>",
        ["path", "row_no", "header", "cells"],
    )


def workbook_extract(files: DataFrame) -> DataFrame:
    """The embedded rows as a table whose column types are inferred from all values of a column."""
    return infer_types(table_of_rows(workbook_rows(files)))


def infer_types(table: DataFrame) -> DataFrame:
    """Text columns as long, double or boolean where every value allows it."""
    integer, number = r"^\s*[+-]?[0-9]{1,18}\s*$", r"^\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"
    boolean = r"^(True|False|TRUE|FALSE|true|false)$"
    tests = []
    for i, name in enumerate(table.columns):
        col = F.col(ident(name))
        for kind, pattern in (("l", integer), ("d", number), ("b", boolean)):
            tests.append(F.bool_and(col.rlike(pattern)).alias(f"{kind}{i}"))
    if not tests:
        return table
    fits = table.agg(*tests).first()
    casts = []
    for i, name in enumerate(table.columns):
        kind = next((t for k, t in (("l", "bigint"), ("d", "double"), ("b", "boolean")) if fits[f"{k}{i}"]), None)
        col = F.col(ident(name))
        casts.append((F.trim(col).cast(kind) if kind else col).alias(name))
    return table.select(*casts)


def load_workbook(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """Embedded rows where the workbooks hold any, else their column catalog."""
    files = binary_files(spark, config["path"])
    profile = workbook_profile(files)
    has_text = not profile.where(F.col("data_source_type") == "csv").isEmpty()
    if config.get("extract_data", True) and has_text:
        return workbook_extract(files)
    catalog = workbook_catalog(files)
    wanted = config.get("datasource_name")
    if wanted:
        catalog = catalog.join(match_names(catalog, wanted), ["path", "datasource_name"], "left_semi")
    return catalog.select(*CATALOG_COLUMNS)


def match_names(catalog: DataFrame, wanted: str) -> DataFrame:
    """Per workbook the datasource called ``wanted``, or the most similar one."""
    names = catalog.groupBy("path", "datasource_name").agg(F.min("place").alias("place"))
    pairs = names.withColumn("wanted", F.lit(wanted)).withColumnRenamed("datasource_name", "name")
    best = fuzzy_name_match(pairs, "path")
    return best.where("match IS NOT NULL").select("path", F.col("match").alias("datasource_name"))


def name_similarity(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length, regardless of case."""
    return 1 - F.levenshtein(F.lower(a), F.lower(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def fuzzy_name_match(pairs: DataFrame, group: str) -> DataFrame:
    """Best candidate per group from rows (group, wanted, name, place): the equal name, else the most similar.

    Similarity must exceed one half; of equally similar names the earlier one wins. Every candidate belongs
    to one wanted name, so the work grows with the catalog, and the maximum is taken inside tasks first.
    """
    wanted, name = F.col("wanted"), F.col("name")
    scored = pairs.withColumn("ratio", F.when(wanted == name, F.lit(2.0)).otherwise(name_similarity(wanted, name)))
    best = F.max(F.when(F.col("ratio") > LEAST_SIMILARITY, F.struct("ratio", (-F.col("place")).alias("p"), "name")))
    return (
        scored.groupBy(group, "wanted")
        .agg(best.alias("best"))
        .select(group, "wanted", F.col("best.name").alias("match"))
    )

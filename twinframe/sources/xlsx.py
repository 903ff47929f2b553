"""Excel workbooks as a Spark source: a folder of ``.xlsx`` files, one task per file."""

from __future__ import annotations

import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

from twinframe.sources.archives import binary_files, rows_of_archives, table_of_rows

# Fixed values of the file format: namespaces, built-in date formats and the day serial number 0 of both date systems.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
BUILTIN_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
DAY_ZERO = datetime(1899, 12, 30)
DAY_ZERO_1904 = datetime(1904, 1, 1)

_SCHEMA = "path string, sheet string, row_no int, header array<string>, cells array<string>"
_COLUMNS = ["path", "sheet", "row_no", "header", "cells"]


def xlsx_rows(files: DataFrame, sheet: int | str = 0) -> DataFrame:
    """Rows of one sheet, by number or name, of every workbook in ``files``.

    The first row of a sheet is its header and travels with every row, so files of different layouts can be
    told apart without a join.
    """

    def read(path: str, archive: zipfile.ZipFile) -> Iterator[tuple]:
        name, member = _find_sheet(archive, sheet)
        shared, dates, zero = _shared_strings(archive), _date_styles(archive), _day_zero(archive)
        header = None
        with archive.open(member) as handle:
            for _, element in ElementTree.iterparse(handle):
                if element.tag == f"{MAIN}row":
                    cells = _cells(element, shared, dates, zero)
                    if header is None and any(c is not None for c in cells):
                        header = cells
                    elif any(c is not None for c in cells):
                        yield path, name, int(element.get("r", 0)), header, cells
                    element.clear()

    return rows_of_archives(files, read, _SCHEMA, _COLUMNS)


def read_xlsx(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    return xlsx_table(binary_files(spark, path), sheet)


def xlsx_table(files: DataFrame, sheet: int | str = 0) -> DataFrame:
    """The sheet as a table: the first row of each file is its header; cells are text, empty cells null."""
    return table_of_rows(xlsx_rows(files, sheet))


def _find_sheet(archive: zipfile.ZipFile, sheet: int | str) -> tuple[str, str]:
    book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
    sheets = [(s.get("name"), s.get(RELATION)) for s in book.iter(f"{MAIN}sheet")]
    if isinstance(sheet, int):
        name, relation = sheets[sheet]
    else:
        name, relation = next(s for s in sheets if s[0] == sheet)
    links = ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in links if r.get("Id") == relation)
    return name, target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)


def _day_zero(archive: zipfile.ZipFile) -> datetime:
    settings = ElementTree.fromstring(archive.read("xl/workbook.xml")).find(f"{MAIN}workbookPr")
    since_1904 = settings is not None and settings.get("date1904", "0") in ("1", "true")
    return DAY_ZERO_1904 if since_1904 else DAY_ZERO


def _shared_strings(archive: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    root = ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in root.iter(f"{MAIN}si")]


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date or time."""
    if "xl/styles.xml" not in archive.namelist():
        return set()
    root = ElementTree.fromstring(archive.read("xl/styles.xml"))
    formats = set(BUILTIN_DATE_FORMATS)
    for custom in root.iter(f"{MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", custom.get("formatCode", ""))
        if re.search(r"[ymdhs]", code, re.IGNORECASE):
            formats.add(int(custom.get("numFmtId")))
    styles = root.find(f"{MAIN}cellXfs")
    return {i for i, x in enumerate(styles if styles is not None else []) if int(x.get("numFmtId", 0)) in formats}


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]*", reference).group(0):
        number = number * 26 + ord(letter) - 64
    return number - 1


def _cells(row: ElementTree.Element, shared: list[str], dates: set[int], zero: datetime) -> list[str | None]:
    cells: list[str | None] = []
    for cell in row.iter(f"{MAIN}c"):
        place = _column_number(cell.get("r", "")) if cell.get("r") else len(cells)
        cells.extend([None] * (place - len(cells)))
        cells.append(_cell_text(cell, shared, dates, zero))
    return cells


def _cell_text(cell: ElementTree.Element, shared: list[str], dates: set[int], zero: datetime) -> str | None:
    kind, value = cell.get("t", "n"), cell.find(f"{MAIN}v")
    if kind == "inlineStr":
        text = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    elif value is None or value.text is None:
        return None
    elif kind == "s":
        text = shared[int(value.text)]
    elif kind == "b":
        text = "True" if value.text == "1" else "False"
    elif kind == "n" and int(cell.get("s", 0)) in dates:
        text = str(zero + timedelta(milliseconds=round(float(value.text) * 86_400_000)))
    else:
        text = value.text
    return text or None

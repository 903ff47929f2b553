"""Files built from tables inside Spark tasks, so that file readers have inputs that grow with the tables.

Rows are cut into blocks by key, and every block becomes one small file.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _per_block(df: DataFrame, key: str, rows: int, build: Callable[[pd.DataFrame], bytes]) -> DataFrame:
    """``path`` and ``content``: one file per ``rows`` consecutive keys."""
    columns = df.columns

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["_block"].iloc[0])
        content = build(pdf.sort_values(key)[columns])
        return pd.DataFrame({"path": [f"block-{block:08d}"], "content": [content]})

    blocks = df.withColumn("_block", F.floor(F.col(key) / rows))
    return blocks.groupBy("_block").applyInPandas(make, "path string, content binary")


def _zipped(members: dict[str, str]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in members.items():
            archive.writestr(name, text)
    return buffer.getvalue()


_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def sheet_xml(rows: list[list], date_columns: frozenset[int] = frozenset()) -> str:
    """Rows as a sheet: numbers as numbers, texts inline, None as no cell."""

    def cell(number: int, column: int, value: object) -> str:
        if value is None:
            return ""
        place = f'r="{chr(65 + column)}{number}"'
        if isinstance(value, (int, float)):
            style = ' s="1"' if column in date_columns else ""
            return f"<c {place}{style}><v>{value!r}</v></c>"
        return f'<c {place} t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    lines = [
        f'<row r="{n}">' + "".join(cell(n, c, v) for c, v in enumerate(row)) + "</row>"
        for n, row in enumerate(rows, 1)
    ]
    return f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>'


def xlsx_bytes(sheets: dict[str, str]) -> bytes:
    names = list(sheets)
    book = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
    links = "".join(
        f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>'
        for i in range(1, len(names) + 1)
    )
    members = {
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{book}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}">{links}</Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    }
    members |= {f"xl/worksheets/sheet{i}.xml": sheets[n] for i, n in enumerate(names, 1)}
    return _zipped(members)


def xlsx_files(df: DataFrame, key: str, rows: int = 500) -> DataFrame:
    """Workbooks whose second sheet, ``data``, holds the rows."""

    def build(pdf: pd.DataFrame) -> bytes:
        body = [[None if v is None else v for v in r] for r in pdf.astype(object).itertuples(index=False)]
        return xlsx_bytes({"cover": sheet_xml([["cover"]]), "data": sheet_xml([list(pdf.columns), *body])})

    return _per_block(df, key, rows, build)


def twb_xml(title: str, datasources: dict[str, list[tuple[str, str]]], worksheets: int, dashboards: int) -> str:
    """A workbook layout with metadata records per datasource, and a built-in one to be left out."""
    parts = ['<datasource name="Parameters"><column name="[P]" datatype="string"/></datasource>']
    for name, columns in datasources.items():
        records = "".join(
            f"<metadata-record><local-name>[{escape(c)}]</local-name><local-type>{t}</local-type></metadata-record>"
            for c, t in columns
        )
        records += "<metadata-record><local-name>[System Row]</local-name><local-type>integer</local-type></metadata-record>"
        parts.append(f"<datasource caption={quoteattr(name)} name='ds'>{records}</datasource>")
    sheets = "<worksheets>" + "<worksheet/>" * worksheets + "</worksheets>"
    boards = "<dashboards>" + "<dashboard/>" * dashboards + "</dashboards>"
    return f"<workbook name={quoteattr(title)}><datasources>{''.join(parts)}</datasources>{sheets}{boards}</workbook>"


def embedded_workbooks(df: DataFrame, key: str, rows: int = 500) -> DataFrame:
    """Workbooks with the rows as an embedded text file, tab separated in every second block."""

    def build(pdf: pd.DataFrame) -> bytes:
        tabbed = (int(pdf[key].iloc[0]) // rows) % 2 == 1
        text = pdf.to_csv(index=False, sep="\t" if tabbed else ",")
        layout = twb_xml("rows", {"Extract": [(c, "string") for c in pdf.columns]}, 2, 1)
        return _zipped({"book.twb": layout, "Data/rows.csv": text})

    return _per_block(df, key, rows, build)


def catalog_workbooks(df: DataFrame, key: str, source: str, column: str, datatype: str, rows: int = 500) -> DataFrame:
    """Workbooks without data whose datasources and columns are the values of the rows."""

    def build(pdf: pd.DataFrame) -> bytes:
        datasources = {
            str(name): list(zip(group[column].astype(str), group[datatype].astype(str)))
            for name, group in pdf.groupby(source)
        }
        return _zipped({"book.twb": twb_xml("catalog", datasources, len(pdf) % 7, len(pdf) % 3)})

    return _per_block(df, key, rows, build)

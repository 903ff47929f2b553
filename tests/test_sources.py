import io
import zipfile

import pandas as pd
import pytest
import yaml
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from twinframe import load_source, register_source
from twinframe.jobs import run as job
from twinframe.operators.sampling import limited
from twinframe.plans.metadata import metadata_compare
from twinframe.session import scratch_path
from twinframe.sources import encoding, files, sinks, workbook, xlsx
from twinframe.spec import ValidationSpec
from workloads.containers import sheet_xml, twb_xml, xlsx_bytes


def csv(spark, tmp_path, text, name="a.csv", mode="utf-8", **config):
    path = tmp_path / name
    path.write_bytes(text if isinstance(text, bytes) else text.encode(mode))
    return load_source(spark, {"type": "file", "path": str(path), **config})


def cells(df):
    return [tuple(r) for r in df.collect()]


def test_csv_keeps_text_and_nulls_only_empty_cells(spark, tmp_path):
    df = csv(spark, tmp_path, 'ID,Name,X\n01,NA,\n2,null,""\n3,"a ""b"", c",  d \n4\n')
    assert df.columns == ["id", "name", "x"]
    assert cells(df) == [("01", "NA", None), ("2", "null", None), ("3", 'a "b", c', "  d "), ("4", None, None)]


@pytest.mark.parametrize("line", ["1,2,3,4", "1,2,3,"])
def test_csv_rejects_surplus_cells(spark, tmp_path, line):
    df = csv(spark, tmp_path, f"a,b,c\n1,2,3\n{line}\n")
    with pytest.raises(Exception, match="Expected 3 fields"):
        df.count()


def test_csv_line_breaks_inside_cells(spark, tmp_path):
    assert cells(csv(spark, tmp_path, 'a,b\n1,"x\ny"\n2,z\n')) == [("1", "x\ny"), ("2", "z")]


@pytest.mark.parametrize("mode", ["utf-8", "utf-8-sig", "utf-16", "iso-8859-1"])
def test_csv_encodings_are_found(spark, tmp_path, mode):
    df = csv(spark, tmp_path, "k,v\n1,été\n2,x\n", mode=mode)
    assert df.columns == ["k", "v"] and cells(df) == [("1", "été"), ("2", "x")]


def test_csv_named_encoding_and_separator(spark, tmp_path):
    df = csv(spark, tmp_path, "k|v\n1|€ – “x”\n", "a.txt", "cp1252", format="csv", sep="|", encoding="cp1252")
    assert cells(df) == [("1", "€ – “x”")]
    with pytest.raises(ValueError, match="encoding"):
        encoding.spark_charset("klingon")


def test_formats(spark, tmp_path):
    assert files.detect_format("/x/A.CSV") == "csv" and files.detect_format("b.xlsx") == "excel"
    with pytest.raises(ValueError, match="extension"):
        files.detect_format("/x/a.tsv")
    with pytest.raises(FileNotFoundError):
        load_source(spark, {"type": "file", "path": str(tmp_path / "none.csv")})
    with pytest.raises(ValueError, match="Unknown source"):
        load_source(spark, {"type": "ftp"})


@pytest.mark.parametrize(
    "orient, text",
    [
        ("records", '[{"A": 1, "b": "x"}, {"A": 2, "b": null}]'),
        ("index", '{"0": {"A": 1, "b": "x"}, "1": {"A": 2, "b": null}}'),
        ("columns", '{"A": {"0": 1, "1": 2}, "b": {"0": "x", "1": null}}'),
        ("values", '[[1, "x"], [2, null]]'),
    ],
)
def test_json_layouts(spark, tmp_path, orient, text):
    (tmp_path / "a.json").write_text(text)
    df = load_source(spark, {"type": "file", "path": str(tmp_path / "a.json"), "json_orient": orient})
    assert df.columns == (["0", "1"] if orient == "values" else ["a", "b"])
    assert sorted((str(a), b) for a, b in cells(df)) == [("1", "x"), ("2", None)]


def test_xlsx_sheets_dates_and_gaps(spark, tmp_path):
    first = sheet_xml([["id", "when", "note"], [1, 45292, "a"], [2, 45292.5, None], [3, None, " b "]], frozenset({1}))
    (tmp_path / "a.xlsx").write_bytes(xlsx_bytes({"One": first, "Two": sheet_xml([["z"], [9]])}))
    df = load_source(spark, {"type": "file", "path": str(tmp_path / "a.xlsx")})
    assert cells(df) == [("1", "2024-01-01 00:00:00", "a"), ("2", "2024-01-01 12:00:00", None), ("3", None, " b ")]
    assert cells(xlsx.read_xlsx(spark, str(tmp_path / "a.xlsx"), "Two")) == [("9",)]


def test_limits_and_projection(spark):
    spark.range(50).selectExpr("50 - id AS K", "id AS v").createOrReplaceTempView("limit_source")
    config = {"type": "table", "table": "limit_source", "columns": ["k"], "row_limit": "3"}
    assert cells(load_source(spark, config, order_by=["k"])) == [(1,), (2,), (3,)]
    assert limited(spark.range(9), 4).count() == 4
    with pytest.raises(ValueError):
        load_source(spark, {**config, "row_limit": 0})


def test_own_source_type(spark):
    register_source("numbers", lambda spark, config: spark.range(config["n"]).toDF("N"))
    assert load_source(spark, {"type": "numbers", "n": 3}).columns == ["n"]


def archive(**members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as target:
        for name, text in members.items():
            target.writestr(name.replace("__", "."), text)
    return buffer.getvalue()


def test_workbook_descriptions(spark, tmp_path):
    layouts = {
        "a": twb_xml("w", {"Sales": [("Amount", "real")]}, 2, 1),
        "b": '<workbook><datasource name="d"><column name="[X]" datatype="integer"/><column caption="Y"/>'
        '<column name="[System Z]"/></datasource></workbook>',
        "c": '<workbook><datasource name="d"><rel name="[Q]" type="t"/><rel name="[Q]"/><rel name="n"/></datasource></workbook>',
        "d": '<workbook><datasource name="Sample - Superstore"><column name="[X]"/></datasource></workbook>',
    }
    for name, text in layouts.items():
        (tmp_path / f"{name}.twbx").write_bytes(archive(book__twb=text))
    files_found = spark.read.format("binaryFile").load(str(tmp_path))
    got = {tuple(r) for r in workbook.workbook_catalog(files_found).select(*workbook.CATALOG_COLUMNS).collect()}
    assert got == {
        ("Sales", "Amount", "real", "[Amount]"),
        ("d", "X", "integer", "[X]"),
        ("d", "Y", "unknown", "Y"),
        ("d", "Q", "t", "[Q]"),
    }
    wanted = load_source(spark, {"type": "datasource", "path": str(tmp_path / "a.twbx"), "datasource_name": "sale"})
    assert cells(wanted.select("column_name")) == [("Amount",)]


def test_workbook_data_types(spark, tmp_path):
    text = "Id,Amount,Flag,Note\n1,1.5,True,a\n2,,False,\n"
    (tmp_path / "a.twbx").write_bytes(archive(b__twb="<workbook/>", rows__csv=text))
    df = load_source(spark, {"type": "datasource", "path": str(tmp_path / "a.twbx")})
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "boolean", "string"]
    assert cells(df) == [(1, 1.5, True, "a"), (2, None, False, None)]


def distance(a, b):
    """Edit distance, row by row."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_names_against_brute_force(spark):
    names = ["Sales Orders", "sales order", "Invoices", "Ordres", "Sale", "X", "Sales Ordering 2024", "rders Sales"]
    wanted = ["Sales Order", "invoice", "zzz", "SALES", "Orders", "Invoices", "x"]
    pairs = spark.createDataFrame(
        [(w, w, n, i) for w in wanted for i, n in enumerate(names)], "g string, wanted string, name string, place int"
    )
    got = {r.wanted: r["match"] for r in workbook.fuzzy_name_match(pairs, "g").collect()}
    for w in wanted:
        scored = [(1 - distance(w.lower(), n.lower()) / max(len(w), len(n)), -i, n) for i, n in enumerate(names)]
        ratio, _, best = max(scored)
        assert got[w] == (w if w in names else best if ratio > 0.5 else None), w


@pytest.mark.parametrize("system, first", [("", "1900-01-01 12:00:00.500000"), ('<workbookPr date1904="1"/>', "1904-01-03 12:00:00.500000")])
def test_date_systems_of_workbooks(spark, tmp_path, system, first):
    sheet = (
        '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
        '<row r="1"><c r="A1" t="inlineStr"><is><t>d</t></is></c></row>'
        f'<row r="2"><c r="A2" s="1"><v>{2 + (43200.5 / 86400)!r}</v></c></row></sheetData></worksheet>'
    )
    with zipfile.ZipFile(io.BytesIO(xlsx_bytes({"s": sheet}))) as made, zipfile.ZipFile(tmp_path / "a.xlsx", "w") as kept:
        for name in made.namelist():
            kept.writestr(name, made.read(name).decode().replace("<sheets>", f"{system}<sheets>"))
    assert cells(load_source(spark, {"type": "file", "path": str(tmp_path / "a.xlsx")})) == [(first,)]


def test_broken_json_is_an_error(spark, tmp_path):
    for orient, good, bad in (
        ("index", '{"1": {"a": "x"}}', '{"1": {"a": "x"'),
        ("values", '[["x"]]', '[["x"], ["y'),
        ("records", '[{"a": "x"}]', '[{"a": "x"}, {"a": '),
    ):
        folder = tmp_path / orient
        folder.mkdir()
        (folder / "a.json").write_text(good)
        assert files.read_json(spark, str(folder), orient).count() == 1
        (folder / "b.json").write_text(bad)
        with pytest.raises((PySparkException, ValueError)):
            files.read_json(spark, str(folder), orient).collect()


def test_files_of_a_folder_with_other_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,t\n1,x\n")
    (tmp_path / "b.csv").write_text("t,id\ny,2\n")
    assert sorted(cells(files.read_csv(spark, str(tmp_path)))) == [("1", "x"), ("2", "y")]
    (tmp_path / "c.csv").write_text("id,u\n1,x\n")
    with pytest.raises(ValueError, match="Columns"):
        files.read_csv(spark, str(tmp_path))


def test_sinks_keep_every_text(spark, tmp_path):
    texts = ['say "x", then', "line\nbreak", "", "plain", "it's", "\\back"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").selectExpr("CAST(i AS STRING) i", "t")
    path = sinks.write_results(df, str(tmp_path), "My Run/1", stamp="20240101_000000")
    assert path.endswith("my_run_1_20240101_000000.csv")
    assert sorted(cells(sinks.read_results(spark, path))) == [(str(i), t) for i, t in enumerate(texts)]
    table = str(tmp_path / "table")
    sinks.append_results(df, table, "r1")
    sinks.append_results(df, table, "r2")
    assert spark.read.parquet(table).groupBy("run_id").count().count() == 2


def test_metadata_compare_reports_what_cannot_be_opened(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n3,4\n")
    spark.range(2).selectExpr("id AS a", "id AS b").createOrReplaceTempView("meta_target")
    good = {"type": "file", "path": str(tmp_path / "a.csv")}
    target = {"type": "table", "table": "meta_target"}
    specs = [
        ValidationSpec(name="same", source=good, target=target),
        ValidationSpec(name="no_file", source={"type": "file", "path": str(tmp_path / "z.csv")}, target=target),
        ValidationSpec(name="no_table", source=good, target={"type": "table", "table": "absent"}),
    ]
    got = {r.name: (r.csv_rows, r.table_rows, r.rows_match, r.status) for r in metadata_compare(spark, specs).collect()}
    assert got == {
        "same": ("2", "2", "YES", "PASSED"),
        "no_file": ("ERROR", "N/A", "ERROR", "FAILED"),
        "no_table": ("2", "ERROR", "ERROR", "FAILED"),
    }


def test_job_runs_a_configuration(spark, tmp_path):
    pd.DataFrame({"id": [1, 2, 3], "v": ["a", "b", "c"]}).to_csv(tmp_path / "s.csv", index=False)
    pd.DataFrame({"id": [1, 2, 3], "v": ["a", "b", "x"]}).to_csv(tmp_path / "t.csv", index=False)
    entry = {"primary_keys": "id", "output_dir": str(tmp_path / "out")}

    def side(name):
        return {"type": "file", "path": str(tmp_path / f"{name}.csv")}

    config = {
        "validations": [
            {"name": "same", "source": side("s"), "target": side("s"), **entry},
            {"name": "other", "source": side("s"), "target": side("t"), **entry},
        ]
    }
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(config))
    assert job.main(["--config", str(tmp_path / "c.yaml"), "--name", "same"]) == 0
    assert job.main(["-c", str(tmp_path / "c.yaml"), "-o", str(tmp_path / "both")]) == 1
    written = sorted(p.name.rsplit("_", 2)[0] for p in (tmp_path / "both").iterdir())
    assert written == ["consolidated", "other", "same"]
    with pytest.raises(ValueError):
        job.arguments(["-c", "x", "--target-limit", "0"])
    assert job.main(["-c", str(tmp_path / "c.yaml"), "-o", str(tmp_path / "meta"), "--metadata-only"]) == 0


def test_scratch_follows_the_cluster_setting(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_encoding_of_bytes(spark):
    contents = [b"plain", "é".encode(), "é".encode("latin-1"), "x".encode("utf-16"), b""]
    df = spark.createDataFrame([(str(i), bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")
    got = [r.encoding for r in encoding.detect_encoding(df).orderBy("path").collect()]
    assert got == ["utf-8", "utf-8", "iso-8859-1", "utf-16", "utf-8"]
    texts = [r[0] for r in df.orderBy("path").select(encoding.decoded(F.col("content"))).collect()]
    assert texts == ["plain", "é", "é", "x", ""]

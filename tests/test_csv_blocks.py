"""CSV files with line breaks in cells, read by many tasks."""

import random

import pytest

from twinframe import load_source
from twinframe.sources import csv_blocks, files

CELLS = ["x", "", "5 inch", 'he said "no"', "a,b", "two\nlines", '"', '",\n"', "\n\n", "é ü", '5" pipe', "  spaced ", "end\n"]


def quoted(cell, draw):
    if any(c in cell for c in ',\n"') or draw.random() < 0.3:
        if cell == '5" pipe' and draw.random() < 0.7:
            return cell  # a quote inside of a cell that is not quoted is text
        return '"' + cell.replace('"', '""') + '"'
    return cell


def some_rows(n, seed):
    draw = random.Random(seed)
    return [[str(i), draw.choice(CELLS), draw.choice(CELLS)] for i in range(n)], draw


def as_csv(rows, draw, end):
    return end.join(["id,a,b", *(",".join(quoted(c, draw) for c in r) for r in rows), ""])


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "2000")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("mode", ["utf-8", "latin-1"])
def test_many_splits_give_the_rows_in_order(spark, tmp_path, small_splits, end, mode):
    rows, draw = some_rows(2000, end + mode)
    path = tmp_path / "a.csv"
    path.write_bytes(as_csv(rows, draw, end).encode(mode))
    assert csv_blocks.lines(spark, str(path), ",", "UTF-8").rdd.getNumPartitions() > 5
    df = load_source(spark, {"type": "file", "path": str(path)})
    assert [[c or "" for c in r] for r in df.collect()] == rows


def test_the_rows_are_those_of_one_task(spark, tmp_path, small_splits):
    rows, draw = some_rows(500, 3)
    path = tmp_path / "a.csv"
    text = as_csv(rows, draw, "\n").replace('\n7,', '\n\n\n7,')
    path.write_text(text)
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "nullValue": ""}
    whole = spark.read.options(**options).csv(str(path)).collect()
    assert [tuple(r) for r in files.read_csv(spark, str(path)).collect()] == [tuple(r) for r in whole]


def test_a_folder_of_files_with_and_without_line_breaks_keeps_its_order(spark, tmp_path, small_splits):
    wanted = []
    for k, cells in enumerate([["x", "y"], ["two\nlines", "z"], ["v", "w"]]):
        lines = ["id,a" if k != 2 else "a,id"]
        for i in range(60):
            row = [str(100 * k + i), cells[i % 2]]
            wanted.append(tuple(row))
            quoted_row = [f'"{c}"' for c in row]
            lines.append(",".join(quoted_row if k != 2 else reversed(quoted_row)))
        (tmp_path / f"{k}.csv").write_text("\n".join(lines) + "\n")
    df = files.read_csv(spark, str(tmp_path))
    assert [tuple(r) for r in df.select("id", "a").collect()] == wanted


@pytest.mark.parametrize("text", ['id,a\n1,"x\ny"\n', 'id,a\n1,"x\ny"', 'id,a\r\n1,"x\ny"\r\n\r\n', '﻿id,a\n1,"x\ny"\n'])
def test_ends_of_files(spark, tmp_path, text):
    path = tmp_path / "a.csv"
    path.write_bytes(text.encode())
    df = files.read_csv(spark, str(path))
    assert (df.columns, [tuple(r) for r in df.collect()]) == (["id", "a"], [("1", "x\ny")])


def test_header_alone_with_a_line_break(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,"a\nb"\n')
    df = files.read_csv(spark, str(path))
    assert (df.columns, df.collect()) == (["id", "a\nb"], [])


def test_open_cells_and_surplus_cells_are_errors(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,a\n1,"x\ny\n')
    with pytest.raises(Exception, match="open at the end of .*a.csv"):
        files.read_csv(spark, str(path)).count()
    path.write_text('id,a\n1,"x\ny",z\n')
    with pytest.raises(Exception, match="Expected 2 fields"):
        files.read_csv(spark, str(path)).count()

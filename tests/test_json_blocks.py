"""Objects of JSON files in all layouts, read from one split and from many."""

import gzip
import json
import random

import pytest

from twinframe.sources import files, json_blocks

ODD = ["", "}", "{", '"', "\\", '\\"', "}{", "[", "]", "],", "é😀", "\n", "a}b", '{"k": 1}', "\t/"]


def objects(n, seed):
    draw = random.Random(seed)

    def text():
        return "".join(draw.choice(ODD) for _ in range(draw.randrange(5)))

    return [{"id": i, "s": text(), "deep": {"x": [{"y": text()}, {"y": text()}][: draw.randrange(3)], "z": text()}, "t": text()} for i in range(n)]


LAYOUTS = {
    "lines": lambda rows: "".join(json.dumps(r) + "\n" for r in rows),
    "lines without a last break": lambda rows: "\n".join(json.dumps(r, ensure_ascii=False) for r in rows),
    "windows lines with blank ones": lambda rows: "\r\n\r\n".join(json.dumps(r) for r in rows) + "\r\n",
    "array in one line": lambda rows: json.dumps(rows, ensure_ascii=False),
    "array over lines": lambda rows: json.dumps(rows, indent=2) + "\n",
    "array of lines": lambda rows: "[\n" + ",\n".join(json.dumps(r) for r in rows) + "\n]",
    "without any space": lambda rows: "".join(json.dumps(r) for r in rows),
    "objects over lines": lambda rows: "\n".join(json.dumps(r, indent=1) for r in rows),
    "with a byte order mark": lambda rows: "﻿" + json.dumps(rows, ensure_ascii=False),
}


def plain(rows):
    return [(r.id, r.s, [y.y for y in r.deep.x], r.deep.z, r.t) for r in rows]


@pytest.fixture
def splits(spark):
    """Sets the size of splits, and puts it back."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield cut
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts_from_many_splits(spark, tmp_path, splits, layout):
    """Strings hold braces, brackets, quotes and escapes, and blocks begin inside of them."""
    rows = objects(25, 1)
    (tmp_path / "a.json").write_text(LAYOUTS[layout](rows))
    splits("300b")
    df = files.read_json(spark, str(tmp_path / "a.json"))
    assert json_blocks.fragments(spark, str(tmp_path / "a.json")).rdd.getNumPartitions() > 5
    assert df.columns == ["id", "s", "deep", "t"]
    wanted = [(r["id"], r["s"], [y["y"] for y in r["deep"]["x"]], r["deep"]["z"], r["t"]) for r in rows]
    assert sorted(plain(df.collect())) == sorted(wanted)


def test_lines_are_left_to_the_reader(spark, tmp_path):
    for name, rows in (("a", objects(3, 2)), ("b", objects(4, 3))):
        (tmp_path / f"{name}.json").write_text(LAYOUTS["lines"](rows))
    assert json_blocks.object_lines(spark, str(tmp_path)) == str(tmp_path)
    (tmp_path / "c.json").write_text(LAYOUTS["array in one line"](objects(5, 4)))
    lines = json_blocks.object_lines(spark, str(tmp_path))
    assert lines != str(tmp_path) and files.read_json(spark, str(tmp_path)).count() == 12
    in_order = [json.loads(r.value)["id"] for r in spark.read.text(lines).collect()]
    assert in_order == [*range(3), *range(4), *range(5)]


@pytest.mark.parametrize(
    "text, rows",
    [("", 0), (" \n ", 0), ("[]", 0), ("[ ]\n", 0), ("{}", 1), ('{"a":1}', 1), ('{"a":1}\n{"a":2}\n{"a":3}\n', 3), ('{"a":1} {"a":2}{"a":3}', 3), ('[{"a":"}"}]', 1)],
)
def test_small_files(spark, tmp_path, text, rows):
    (tmp_path / "x.json").write_text(text)
    (tmp_path / "y.json").write_text('{"a": 0}')
    assert files.read_json(spark, str(tmp_path)).count() == rows + 1


@pytest.mark.parametrize(
    "text",
    ['[{"a":1}] trailing', '{"a":1', '[{"a":1}', '[{"a":1},5]', '{"a":1}, {"a":2}', '[{"a":1} {"a":2}]', '{"a":1}}', "1 2", '{"a":"x}', '[{"a":1}][{"a":2}]', '{"a":1}\nnull\n', '{"a":1}]'],
)
def test_other_content_is_an_error(spark, tmp_path, splits, text):
    (tmp_path / "x.json").write_text(text)
    splits("4b")
    with pytest.raises(ValueError, match="Not JSON"):
        files.read_json(spark, str(tmp_path)).collect()


def test_packed_and_wide_files(spark, tmp_path):
    rows = objects(20, 5)
    (tmp_path / "p").mkdir()
    with gzip.open(tmp_path / "p" / "a.json.gz", "wt") as f:
        f.write(LAYOUTS["array over lines"](rows))
    with gzip.open(tmp_path / "p" / "b.json.gz", "wt") as f:
        f.write(LAYOUTS["without any space"](rows))
    assert files.read_json(spark, str(tmp_path / "p")).count() == 40
    (tmp_path / "wide.json").write_bytes(LAYOUTS["array in one line"](rows).encode("utf-16"))
    assert files.read_json(spark, str(tmp_path / "wide.json")).count() == 20

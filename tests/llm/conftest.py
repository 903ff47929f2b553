import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

LONG = " ".join(f"word{i % 9973} and{i}" for i in range(30_000))
SAME = "the quick brown fox jumps over the lazy dog and then sleeps for the rest of a long warm day in June"

#: Null, empty, blank, short and very long texts, copies, repeated rows, null ids, sources and other columns.
EDGES = [
    (1, None, "a.org"),
    (2, "", "a.org"),
    (3, " \n\t\r ", "a.org"),
    (4, "short", None),
    (5, LONG, "b.org"),
    (6, SAME, "b.org"),
    (7, SAME, "b.org"),
    (8, SAME.replace(" a long ", " a very long "), "b.org"),
    (9, SAME, "c.org"),
    (9, SAME, "c.org"),
    (None, "a text without an id but with some words in it", "c.org"),
    (10, "Ünïcode 漢字 “quotes” – ẞ 😀 x y\n\nline\nline\n", "c.org"),
    (11, "# * $ % & | < > " * 30, "d.org"),
    (12, "again and again " * 40, "d.org"),
    (13, "x" * 300_000, "d.org"),
    (14, "<|endoftext|> it's <|endoftext|>", "d.org"),
]
CLASHES = "score double, n_words int, kept string, shard int, slot int, sequence_id int, class_id int, item int, length int, id int"


@pytest.fixture(scope="session")
def edges(spark):
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
    rows = [(d, t, None, s, None if t is None else len(t), *[None] * 10) for d, t, s in EDGES]
    frame = spark.createDataFrame(rows, schema)
    return frame.repartition(3)


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def tables(spark):
    """The smallest given tables."""
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")

"""Every registered query next to its SQL, on the smallest tables."""

import pytest

import check_queries
from twinframe.session import named_paths
from workloads import queries
from workloads.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views():
    return check_queries.open_views(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, views, name):
    verdict, _, _ = check_queries.compare(spark, views, SF, name)
    assert verdict.startswith("ok"), verdict


def test_json_arrays_stay_whole(spark, tmp_path):
    """A join that turns into a broadcast at run time must not deal the rows of one array to several files."""
    texts = spark.range(0, 3000, 1, 6).selectExpr("id AS doc_id", "repeat(concat('a}', id), 20) AS text", "'en' AS lang", "'s' AS source")
    texts.unionByName(texts.where("doc_id % 100 = 0")).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
    try:
        rows = QUERIES["json_large_array"](spark, str(tmp_path)).select("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert sorted(r.doc_id for r in rows) == sorted([*range(3000), *range(0, 3000, 100)])


@pytest.mark.parametrize(("name", "label"), [("data_compare_csv_order", "lines-3-"), ("data_compare_filtered_order", "lines-third-")])
def test_larger_tables_are_sorted_in_more_parts(spark, monkeypatch, name, label):
    monkeypatch.setattr(queries, "SORTED_ROWS", 700, raising=False)
    before = named_paths()
    assert [r.result for r in QUERIES[name](spark, SF).collect()] == ["PASS"]
    folder = next(p for p in named_paths(before) if label in p)
    parts = spark.read.text(folder) if "csv" in name else spark.read.parquet(folder)
    assert parts.selectExpr("regexp_extract(_metadata.file_name, 'part-([0-9]+)', 1) AS part").distinct().count() > 5


def test_csv_order_keeps_little_on_disk(spark):
    """The CSV files are packed, and their rows are not sorted once more to be numbered."""
    before = named_paths()
    assert [r.result for r in QUERIES["data_compare_csv_order"](spark, SF).collect()] == ["PASS"]
    made = named_paths(before)
    assert not [p for p in made if "/ordered-" in p]
    names = {r.n for p in made if "/lines-" in p for r in spark.read.text(p).selectExpr("_metadata.file_name AS n").distinct().collect()}
    assert names and all(n.endswith(".csv.gz") for n in names)

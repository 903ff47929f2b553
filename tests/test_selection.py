"""The first rows of an order, against sorting in Python."""

import pytest
from pyspark.sql import functions as F

from twinframe.operators import keys
from twinframe.operators.selection import first_rows
from twinframe.plans.pair import Pair
from twinframe.operators.profile_checks import Profile


@pytest.fixture
def stored(spark, tmp_path):
    """300 rows: a key of a third of them, nulls, and a unique number."""
    rows = [(None if i % 10 == 0 else 7 if i % 3 == 0 else i % 50, f"t{i % 4}", i) for i in range(300)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, "k int, t string, id int").repartition(5).write.parquet(path)
    return spark.read.parquet(path), rows


def order_of(row):
    return (row[0] is not None, row[0] or 0, row[1])


@pytest.mark.parametrize("n", [1, 30, 31, 64, 150, 299, 300, 1000])
def test_first_rows(stored, n):
    df, rows = stored
    got = [tuple(r) for r in first_rows(df, [F.col("k"), F.col("t")], n, few=0).collect()]
    assert len(got) == len(set(got)) == min(n, 300) and set(got) <= set(rows)
    assert sorted(map(order_of, got)) == sorted(map(order_of, rows))[:n]
    unique = first_rows(df, [F.col("id")], n, few=0)
    assert sorted(r.id for r in unique.collect()) == list(range(min(n, 300)))


def test_without_order_and_of_nothing(spark, stored):
    df, _ = stored
    assert first_rows(df, [], 120, few=0).distinct().count() == 120
    assert first_rows(df.where("id < 0"), [F.col("k")], 3, few=0).count() == 0
    assert first_rows(spark.createDataFrame([(1,)] * 50, "k int"), [F.col("k")], 20, few=0).count() == 20


def test_no_task_merges_all(stored):
    plan = first_rows(stored[0], [F.col("k"), F.col("id")], 150, few=0)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan and "SinglePartition" not in plan.split("Subquery")[0]


def test_sampled_keys_are_the_same_either_way(spark, monkeypatch):
    df = spark.range(500).selectExpr("id % 200 AS k")
    shape = keys.KeyShape.of(df.schema, df.schema, ["k"])
    small = {r[0] for r in keys.sample_keys(df, shape, 60, 42).collect()}
    monkeypatch.setattr(keys, "first_rows", lambda *a: first_rows(*a, few=0))
    assert {r[0] for r in keys.sample_keys(df, shape, 60, 42).collect()} == small and len(small) == 60


def test_date_form_follows_the_other_side(spark):
    def ranges(source, target):
        sides = [spark.createDataFrame([(v,) for v in side], "d string") for side in (source, target)]
        return Profile(Pair(*sides), ["dates"]).ranges.get("d")

    first, last = "2024-01-02 00:00:00", "2024-01-03 00:00:00"
    assert ranges(["02/01/2024", "03/01/2024"], ["02/01/2024", "25/01/2024"])[:2] == (first, last)
    assert ranges(["01/02/2024", "01/03/2024"], ["01/02/2024", "01/25/2024"])[:2] == (first, last)
    assert ranges(["01/02/2024", "01/03/2024"], ["2024-01-02"]) == (first, last, first, first)
    assert ranges(["no date", None, ""], ["2024-01-02"]) is None
    assert ranges(["12345678 items in stock"], ["2024-01-02"]) is None

"""Plans of a pair: how often sides are joined, and where rows of repeated keys are combined."""

from pyspark.sql import functions as F

from twinframe.operators import keys as ks
from twinframe.operators.profile_checks import distinct_counts
from twinframe.plans import pair as pairs
from twinframe.plans.pair import Pair


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_reduction_joins_a_union_once(spark):
    source = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, v string")
    target = source.unionByName(spark.createDataFrame([(2, "x"), (7, "y")], "id long, v string")).unionByName(source)
    pair = Pair(source, target, ["id"])
    assert plan(pair.target).count("Join ") == 1
    assert sorted(map(str, pair.target.collect())) == sorted(map(str, target.where("id IS NULL OR id <> 7").collect()))


def test_key_table_is_one_aggregate(spark):
    source = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "id long, v string")
    target = spark.createDataFrame([(1, "a"), (3, "b")], "id int, v string")
    shape = ks.KeyShape.of(source.schema, target.schema, ["id"])
    table = ks.key_table(source, target, shape)
    assert "Join " not in plan(table)
    assert sorted(tuple(r) for r in table.collect()) == [(0, 1, 1, 0), (1, 0, 2, 1), (3, 0, 0, 1)]


def test_copies_are_combined_in_tasks_only_for_frequent_keys(spark, monkeypatch):
    source = spark.range(400).select((F.col("id") % 90).alias("k"), (F.col("id") * 7 % 13).cast("double").alias("v"), F.col("id").alias("w"))
    target = source.withColumn("v", F.col("v").cast("string"))
    found = []
    for many in (1, 10_000):
        monkeypatch.setattr(pairs, "MANY_COPIES", many)
        rows, _ = Pair(source, target, ["k"]).matched(["k", "v", "w"], ["k", "v", "w"])
        found.append(("RepartitionByExpression" in plan(rows), sorted(tuple(r) for r in rows.collect())))
    assert [f[0] for f in found] == [False, True]
    assert found[0][1] == found[1][1] and len(found[0][1]) == 90
    assert all(float(r[3]) == float(r[6]) for r in found[0][1])


def test_reduction_finds_differing_rows_without_a_second_join(spark):
    source = spark.range(60).selectExpr("id % 40 AS k", "IF(id % 9 = 0, NULL, id % 5) AS v", "CAST(id AS STRING) AS w")
    source = source.unionByName(source.where("k < 3"))  # equal copies
    target = source.where("k <> 7").selectExpr("k", "IF(k % 4 = 0, v + 1, v) AS v", "IF(k % 6 = 0, NULL, w) AS w")
    for sides in ((source, target), (target, source)):
        pair, old = (Pair(*sides, ["k"], stage_subset=staged) for staged in (True, False))
        rows, names = pair.differing()
        assert old.differing() is None and "Join " not in plan(rows)
        wanted, _ = old.matched(pair.common, pair.common)
        wanted = wanted.where("NOT (s_1 <=> t_1 AND s_2 <=> t_2)")
        got = sorted(map(str, rows.select(wanted.columns).collect()))
        assert got == sorted(map(str, wanted.collect())) and len(got) > 10
        assert rows.select(names).distinct().count() == len(got)
        kept = pair.source if pair.stats.reduced == "source" else pair.target
        assert sorted(map(str, kept.collect())) == sorted(map(str, source.where("k <> 7").collect()))


def test_rows_by_key_go_to_more_parts_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(ks, "PART_ROWS", 10)
    source = spark.range(200).selectExpr("id AS k", "id % 3 AS v")
    assert ks.by_key(source, ["k"], 200).rdd.getNumPartitions() == 20
    assert "RepartitionByExpression" in plan(ks.by_key(source, ["k"]))


def test_distinct_whole_number_keys_are_counted_in_the_key_table(spark):
    source = spark.range(90).selectExpr("IF(id % 8 = 0, NULL, id % 30) AS k", "CAST(id % 7 AS INT) AS j", "CAST(id % 4 AS STRING) AS v")
    target = source.where("k > 5 OR j = 2").selectExpr("CAST(k AS INT) AS k", "j", "v").unionByName(spark.sql("SELECT 77 AS k, 1 AS j, 'x' AS v"))
    for subset in (True, False):
        pair = Pair(source, target, ["k", "j"], subset=subset)
        counts = distinct_counts(pair)
        wanted = [(i, *[df.select(c).dropna().distinct().count() for df in (pair.source, pair.target)]) for i, c in enumerate(pair.common)]
        assert sorted(tuple(r) for r in counts.collect()) == wanted and any(s != t for _, s, t in wanted)
        assert "max(s" in plan(counts)

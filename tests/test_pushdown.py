"""Keys sent to a database, bounds of a split read and estimated distinct counts."""

import duckdb
import pytest

from twinframe.operators import keys, profile_checks, sampling
from twinframe.plans import validate as plan
from twinframe.plans.pair import Pair
from twinframe.sources import pushdown, tables
from twinframe.spec import ValidationSpec

ROWS = [(1, "a"), (2, "A "), (3, "o'x"), (None, "b"), (5, None), (6, "zz")]


@pytest.mark.parametrize("chunk", [1, 2, 500])
def test_predicates_find_each_row_once(chunk):
    connection = duckdb.connect()
    connection.execute('CREATE TABLE t ("Id" INTEGER, "n""m" VARCHAR)')
    connection.executemany("INSERT INTO t VALUES (?, ?)", ROWS)

    def found(columns, wanted):
        parts = pushdown.key_predicates(columns, wanted, chunk)
        return parts, [r for p in parts for r in connection.execute(f"SELECT * FROM t WHERE {p}").fetchall()]

    assert sorted(found(["Id"], [(1,), (3,), (None,), (99,)])[1], key=str) == sorted([ROWS[0], ROWS[2], ROWS[3]], key=str)
    assert sorted(found(["Id", 'n"m'], [ROWS[2], ROWS[4], (1, "b")])[1], key=str) == sorted([ROWS[2], ROWS[4]], key=str)
    parts, rows = found(['n"m'], [("a",), ("A ",), ("zz",)])
    assert sorted(rows) == [ROWS[0], ROWS[1], ROWS[5]] and sum("'a'" in p and "'A '" in p for p in parts) == 1
    assert found(["Id"], []) == (["1 = 0"], [])


def test_only_keys_that_compare_alike_are_sent(spark):
    def sent(source, target):
        left, right = spark.createDataFrame([(v,) for v in source], "k " + target[0]), spark.createDataFrame([], "k " + target[1])
        shape, sample = sampling.sampled_keys(left, right, ["k"], ["k"], 10, 42)
        return pushdown.key_values(sample, shape, [right.schema["k"].dataType])

    assert sorted(sent([1, 2, 2], ("int", "long"))) == [(1,), (2,)]
    assert sorted(sent(["a", None], ("string", "string")), key=str) == [("a",), (None,)]
    assert sent(["é"], ("string", "string")) is None and sent(["a\\b"], ("string", "string")) is None
    assert sent(["1"], ("string", "int")) is None and sent([1.0], ("double", "double")) is None


def test_sample_reaches_a_jdbc_target(spark, monkeypatch):
    """The read itself is replaced by views, as no database may run: it gets predicates of the sampled keys only."""
    asked = []
    whole = spark.range(100).selectExpr("id AS ID", "id * 2 AS V")

    def load(spark, config):
        asked.append(config.get("predicates"))
        if not config.get("predicates"):
            return whole
        rows = whole.where(" OR ".join(config["predicates"]).replace('"', "`"))
        asked.append(rows.count())
        return rows

    monkeypatch.setattr(plan, "load_table", load)
    monkeypatch.setitem(plan.load_source.__globals__["_loaders"], "table", load)
    whole.createOrReplaceTempView("pushed_source")
    monkeypatch.setitem(plan.load_source.__globals__["_loaders"], "view", lambda spark, config: spark.table(config["table"]))
    spec = ValidationSpec(
        source={"type": "view", "table": "pushed_source"}, target={"type": "table", "url": "jdbc:x", "table": "t"},
        primary_keys="id", quick_sample_pks=7,
    )
    result = plan.validate(spark, spec)
    assert not result.failed() and 7 in asked and result.pair.stats.target_rows == 7


def test_learned_bounds():
    options = {"url": "u", "dbtable": '"s"."t"', "partitionColumn": "id", "user": "me"}
    seen = []

    def first(o):
        seen.append(o)
        return (3, 90)

    full = tables.learned_bounds(options, first)
    assert seen == [{"url": "u", "user": "me", "query": 'SELECT min("id") AS low, max("id") AS high FROM "s"."t"'}]
    assert (full["lowerBound"], full["upperBound"], full["numPartitions"]) == ("3", "90", "32")
    assert tables.learned_bounds({**options, "numPartitions": "4"}, first)["numPartitions"] == "4"
    assert "partitionColumn" not in tables.learned_bounds(options, lambda o: (None, None))
    given = {**options, "lowerBound": "1", "upperBound": "2"}
    assert tables.learned_bounds(given, None) == given and tables.learned_bounds({"dbtable": "t"}, None) == {"dbtable": "t"}


def test_estimates_merge_and_keep_their_error(spark):
    df = spark.range(40_000).selectExpr("id AS i", "id % 7 AS few", "CAST(id % 900 AS STRING) AS t", "id / 3D AS d", "DATE '2024-01-01' + CAST(id % 500 AS INT) AS day", "CAST(NULL AS INT) AS none")
    exact = {r.c: (r.n_s, r.n_t) for r in profile_checks.distinct_counts(Pair(df, df.where("few < 3"))).collect()}
    estimates = profile_checks.distinct_estimates(Pair(df.repartition(9), df.where("few < 3")))
    for r in estimates.collect():
        for got, wanted in zip((r.n_s, r.n_t), exact.get(r.c, (0, 0))):
            assert abs(got - wanted) <= 4 * profile_checks.SKETCH_ERROR * wanted
    passed = profile_checks.distinct_check(Pair(df, df.repartition(3)), estimate=True).collect()
    assert [r.result for r in passed] == ["PASS"]
    failed = profile_checks.distinct_check(Pair(df, df.where("i < 20000")), estimate=True).collect()
    assert sorted(r.column for r in failed) == ["d", "i"]

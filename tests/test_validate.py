import os
import time

import pytest

from twinframe import Pair, ValidationSpec, register_check
from twinframe.operators.ordinal import with_position
from twinframe.operators.value_checks import HASH, VALUE, RowChecks
from twinframe.plans.validate import unregister_check, validate, validate_frames
from twinframe.session import named_paths, stage

BASE = "id bigint, name string, email string, age int, status string"
PEOPLE = [(i, f"n{i}", f"n{i}@x", 20 + i, "on") for i in range(1, 6)]


def people(spark, **changes):
    data = [list(r) for r in PEOPLE]
    for place, (column, value) in changes.get("cells", {}).items():
        data[place][column] = value
    return spark.createDataFrame([tuple(r) for r in data] + changes.get("extra", []), BASE)


def validated(source, target, **options):
    return validate_frames(source, target, ValidationSpec(**options))


def by_check(result):
    found = {}
    for r in result.df.collect():
        found.setdefault(r.validation, []).append(r)
    return found


def failures(result):
    return [r for r in result.df.collect() if r.result == "FAIL"]


def test_one_changed_value(spark, rows):
    result = validated(people(spark), people(spark, cells={1: (3, 99)}), primary_keys="id")
    failed = [r for r in rows(result) if r[1] == "FAIL"]
    assert failed == [
        ("data_validation", "FAIL", "age", "", "1 mismatches in column age", "", ""),
        ("data_validation", "FAIL", "age", "id=2", "Value mismatch (example 1 of 1)", "22", "99"),
    ]
    assert result.failed()
    assert result.summary().first().status == "FAIL"
    assert "1 mismatches in column age" in result.signoff().first().reason


@pytest.mark.parametrize("keys", ["id", ""])
def test_a_table_equals_itself(spark, keys):
    result = validated(people(spark), people(spark), primary_keys=keys, regression=True, order_by="id")
    assert failures(result) == []
    assert result.signoff().first().status == "PASS"


def test_swapping_sides_swaps_values(spark):
    left, right = people(spark), people(spark, cells={0: (1, "x"), 4: (4, None)}, extra=[(9, "z", "", 1, "off")])
    forward = validated(left, right, primary_keys="id", subset=False, regression=True).df.collect()
    backward = validated(right, left, primary_keys="id", subset=False, regression=True).df.collect()

    def cells(rows, flip):
        return sorted(
            (r.column, r.pk, *((r.target_value, r.source_value) if flip else (r.source_value, r.target_value)))
            for r in rows
            if r.validation in ("data_validation", "null_check", "record_count_check", "distinct_value_check")
        )

    assert cells(forward, False) == cells(backward, True)


def test_every_injected_edit_is_counted(spark):
    source = spark.range(2000).selectExpr("id", "id % 7 AS a", "CAST(id AS STRING) AS b")
    target = source.selectExpr("id", "IF(id % 10 = 0, a + 1, a) AS a", "IF(id % 100 = 3, 'x', b) AS b")
    found = by_check(validated(source, target, primary_keys="id"))["data_validation"]
    assert sorted(r.detail for r in found if r.pk == "") == ["20 mismatches in column b", "200 mismatches in column a"]
    assert len([r for r in found if r.pk]) == 6


def test_null_keys_match_and_are_counted(spark):
    source = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "id int, v int")
    target = spark.createDataFrame([(None, 1), (1, 4)], "id int, v int")
    found = by_check(validated(source, target, primary_keys="id", subset=False))
    assert [(r.pk, r.detail) for r in found["duplicate_check"] if r.result == "FAIL"] == [
        ("id=None", "Source has 2 duplicate rows (showing first 5 of 2)")
    ]
    assert found["primary_key_match"][0].detail == "Common: 2, Source-only: 0, Target-only: 0"
    assert [r.pk for r in found["data_validation"] if r.pk] == ["id=1"]


def test_nan_counts_as_null(spark):
    source = spark.sql("SELECT 1 AS id, double('NaN') AS v, CAST(NULL AS FLOAT) AS w")
    target = spark.sql("SELECT 1 AS id, CAST(NULL AS DOUBLE) AS v, float('NaN') AS w")
    result = validated(source, target, primary_keys="id", regression=True)
    assert failures(result) == []


def test_text_keys_against_number_keys(spark):
    source = spark.createDataFrame([("001", "5"), ("2", "x"), ("a", "z")], "id string, v string")
    target = spark.createDataFrame([(1, 5), (2, 6)], "id int, v int")
    strict = by_check(validated(source, target, primary_keys="id"))
    assert strict["primary_key_match"][0].detail == "Common: 0, Source-only: 3, Target-only: 2"
    assert "data_validation" not in strict
    shown = sorted(r.pk for r in strict["primary_key_match"] if r.pk)
    assert shown == ["id='001'", "id='2'", "id='a'", "id=1", "id=2"]
    coerced = by_check(validated(source, target, primary_keys="id", key_mode="coerce", regression=True))
    assert coerced["primary_key_match"][0].detail == "Common: 2, Source-only: 0, Target-only: 0"
    assert [r.pk for r in coerced["data_validation"] if r.pk] == ["id=2"]
    assert coerced["leading_zero_check"][0].result == "PASS"  # only the first zero is taken off both texts


def test_leading_zero_rules(spark):
    source = spark.createDataFrame([(1, "0100"), (2, "012")], "id int, v string")
    target = spark.createDataFrame([(1, "100"), (2, "12")], "id int, v string")

    def detail(**options):
        found = by_check(validated(source, target, primary_keys="id", regression=True, **options))
        return found["leading_zero_check"][0].detail

    assert detail() == "Leading zero mismatch: '012' vs '12'"
    assert detail(robust_zeros=True) == "Leading zero mismatch: '0100' vs '100'"


def test_mixed_types(spark):
    source = spark.sql(
        "SELECT * FROM VALUES (1, '12.50', 'true', '1e5', '2024-01-01 00:00:00', 1.0D, 1.10BD),"
        "(2, ' 7 ', '1', '10000000.0', 'x', 2.5D, 2.00BD) AS t(id, a, b, c, d, e, f)"
    )
    target = spark.sql(
        "SELECT * FROM VALUES (1, 12.5D, true, 100000D, TIMESTAMP_NTZ'2024-01-01', 1, 1.1D),"
        "(2, 7D, true, 1e7D, NULL, 2, 2D) AS t(id, a, b, c, d, e, f)"
    )
    found = by_check(validated(source, target, primary_keys="id"))["data_validation"]
    cells = sorted((r.column, r.pk, r.source_value, r.target_value) for r in found if r.pk)
    assert cells == [
        ("b", "id=1", "'true'", "True"),
        ("c", "id=1", "'1e5'", "100000.0"),
        ("d", "id=1", "'2024-01-01 00:00:00'", "Timestamp('2024-01-01 00:00:00')"),
        ("d", "id=2", "'x'", "None"),
        ("e", "id=2", "2.5", "2"),
    ]


def test_nested_columns_are_compared(spark):
    source = spark.sql("SELECT 1 AS id, array(1.5D, 2D) AS v, map('a', 1, 'b', 2) AS m, named_struct('x', 1) AS s")
    same = spark.sql("SELECT 1 AS id, array(1.5D, 2D) AS v, map('b', 2, 'a', 1) AS m, named_struct('x', 1) AS s")
    other = spark.sql("SELECT 1 AS id, array(1.5D, 3D) AS v, map('a', 1) AS m, named_struct('x', 2) AS s")
    assert failures(validated(source, same, primary_keys="id", regression=True)) == []
    found = by_check(validated(source, other, primary_keys="id", regression=True))
    assert sorted(r.column for r in found["data_validation"] if r.pk) == ["m", "s", "v"]


def test_missing_keys(spark):
    source, target = people(spark), people(spark).withColumnRenamed("id", "key")
    found = by_check(validated(source, target, primary_keys="id", regression=True, order_by="name"))
    assert found["duplicate_check"][0].detail == (
        "Primary key columns ['id'] not found in both source and target - duplicate check skipped"
    )
    assert found["data_validation"][0].detail == "Primary key columns missing. Source: [], Target: ['id']"
    assert [found[c][0].result for c in ("checksum_check", "symmetric_difference_check")] == ["SKIP", "SKIP"]
    partly = by_check(validated(people(spark), people(spark).drop("name"), primary_keys="id,name"))
    assert "INFO" in [r.result for r in partly["primary_key_match"]]


def test_reduction_to_the_smaller_side(spark):
    source, target = people(spark), people(spark, extra=[(9, "z", "e", 1, "off")])
    found = by_check(validated(source, target, primary_keys="id"))
    assert found["record_count_check"][0].detail.endswith("records filtered to matching PKs)")
    assert {r.result for r in found["record_count_check"]} == {"PASS", "INFO"}
    whole = by_check(validated(source, target, primary_keys="id", subset=False))
    assert whole["record_count_check"][0].result == "FAIL"
    assert [r.pk for r in whole["primary_key_match"] if r.pk] == ["id=9"]
    apart = spark.createDataFrame([(77, "a", "b", 1, "c")], BASE)
    assert by_check(validated(source, apart, primary_keys="id"))["record_count_check"][0].result == "FAIL"


def test_empty_strings_per_column(spark):
    source = people(spark, cells={0: (1, ""), 1: (2, ""), 2: (2, "")})
    first = by_check(validated(source, people(spark), primary_keys="id"))["empty_string_check"]
    assert [(r.column, r.pk) for r in first] == [("email", "id=2"), ("email", "id=3")]
    every = by_check(validated(source, people(spark), primary_keys="id", all_empty_columns=True))["empty_string_check"]
    assert {r.column for r in every} == {"email", "name"}


def test_checksum_over_all_columns(spark):
    source, target = people(spark), people(spark).selectExpr("*", "1 AS more")
    common = by_check(validated(source, target, primary_keys="id", regression=True))["checksum_check"]
    assert [r.detail for r in common] == ["All 5 row checksums match"]
    options = {"primary_keys": "id", "regression": True, "checksum_columns": "all"}
    every = by_check(validated(source, target, **options))["checksum_check"]
    assert [r.result for r in every] == ["FAIL"] * 5


def test_more_than_five_checksums(spark):
    source = spark.range(50).selectExpr("id", "id AS v")
    target = spark.range(50).selectExpr("id", "id + 1 AS v")
    found = validated(source, target, primary_keys="id", regression=True).ordered().collect()
    shown = [r for r in found if r.validation == "checksum_check"]
    assert [r.pk for r in shown] == [f"id={i}" for i in range(5)] + [""]
    assert shown[-1].detail == "... and 45 more checksum mismatches"


def test_column_specs_and_order(spark):
    spark.sql("CREATE OR REPLACE TEMP VIEW nums AS SELECT 1 AS id, CAST(1 AS DECIMAL(10,2)) AS d, 'x' AS s")
    source = spark.table("nums")
    target = spark.sql("SELECT CAST(1 AS DECIMAL(12,3)) AS d, 1 AS id, 'x' AS s")
    found = by_check(validated(source, target, primary_keys="id", regression=True))
    assert [(r.source_value, r.target_value) for r in found["column_precision_check"]] == [("10,2", "12,3")]
    assert sorted(r.column for r in found["column_order_check"]) == ["d", "id"]
    strict = by_check(validated(source, target.drop("s"), primary_keys="id", strict_columns=True))
    assert strict["column_count_check"][0].result == "FAIL"


def test_dates_in_text(spark):
    source = spark.createDataFrame([(1, "2024-01-31", "01/02/2024"), (2, "bad", None)], "id int, a string, b string")
    target = spark.createDataFrame([(1, "2024-02-01", "01/02/2024"), (2, "bad", None)], "id int, a string, b string")
    found = by_check(validated(source, target, primary_keys="id", regression=True))["date_range_check"]
    assert [(r.column, r.source_value) for r in found] == [("a", "2024-01-31 00:00:00 to 2024-01-31 00:00:00")]


def test_sampling_before_a_table_target(spark):
    source = spark.range(100).selectExpr("id AS X_ID", "id AS v").toDF("x_id", "v")
    target = spark.range(100).selectExpr("CAST(id AS STRING) AS id", "id AS v")
    spec = ValidationSpec(primary_keys="x_id", quick_sample_pks=10, source_prefixes_to_strip=["x_"], key_mode="coerce")
    first = validate_frames(source, target, spec)
    found = by_check(first)
    assert found["record_count_check"][0].detail.startswith("Source: 10 rows, Target: 10 rows (Note")
    again = validate_frames(source, target, spec)
    keys = [sorted(r.x_id for r in v.pair.full_source.withColumnRenamed("id", "x_id").collect()) for v in (first, again)]
    assert keys[0] == keys[1] and len(keys[0]) == 10


def test_sampling_without_a_target_key_keeps_the_target(spark):
    source, target = spark.range(20).selectExpr("id", "id AS v"), spark.range(20).selectExpr("id AS other", "id AS v")
    found = by_check(validated(source, target, primary_keys="id", quick_sample_pks=5, order_by="v"))
    assert found["record_count_check"][0].detail == "Source: 5 rows, Target: 20 rows"


def test_positions_survive_hot_values_and_copies(spark):
    df = spark.range(3000).selectExpr("CAST(IF(id % 3 = 0, 0, id) AS BIGINT) AS k", "id % 2 AS v").repartition(7)
    got = [tuple(r) for r in with_position(df, ["k"]).orderBy("_pos").collect()]
    assert [r[0] for r in got] == list(range(3000))
    assert [r[1:] for r in got] == sorted(tuple(r) for r in df.collect())


def test_positions_follow_file_order(spark, tmp_path):
    spark.range(1000, numPartitions=4).selectExpr("id", "1000 - id AS v").write.parquet(str(tmp_path / "p"))
    got = with_position(spark.read.parquet(str(tmp_path / "p"))).orderBy("_pos").collect()
    assert [r._pos for r in got] == [r.id for r in got] == list(range(1000))


@pytest.fixture
def small_splits(spark):
    """Files are read in splits of a few kilobytes, and sorted rows stay in several files."""
    small = {
        "spark.sql.files.maxPartitionBytes": "8192",
        "spark.sql.files.openCostInBytes": "0",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {name: spark.conf.get(name) for name in small}
    for name, value in small.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_positions_in_text_need_no_sort(spark, tmp_path, small_splits):
    path, before = str(tmp_path / "t"), named_paths()
    rows = spark.range(6000, numPartitions=3).selectExpr("id", "IF(id % 5 = 0, NULL, 'é') AS v")
    rows.repartitionByRange(3, "id").sortWithinPartitions("id").write.option("maxRecordsPerFile", 900).csv(path, header=True)
    df = spark.read.csv(path, header=True, schema="id long, v string")
    assert df.rdd.getNumPartitions() > 5
    for part in (df, df.where("id % 7 > 2")):  # rows that a filter leaves are numbered without gaps
        got = with_position(part).orderBy("_pos").collect()
        assert [r._pos for r in got] == list(range(part.count()))
        assert [r.id for r in got] == sorted(r.id for r in part.collect())
    assert not [p for p in named_paths(before) if "/ordered-" in p]


def test_positions_where_splits_are_dealt_out(spark, tmp_path, small_splits):
    path = str(tmp_path / "t")
    spark.range(2000, numPartitions=2).selectExpr("id", "spark_partition_id() AS p").write.csv(path, header=True)
    df = spark.read.csv(path, header=True, schema="id long, p int").orderBy("p", "id")
    got = [tuple(r) for r in with_position(df).orderBy("_pos").collect()]
    assert got == [(i, i, i // 1000) for i in range(2000)]


@pytest.mark.parametrize("kind", ["csv", "one csv", "parquet", "sorted"])
def test_slices_of_positions_find_every_difference(spark, tmp_path, monkeypatch, small_splits, kind):
    sides = []
    for parts, changed in ((3, "id % 3 = 0"), (5, "false")):
        rows = spark.range(7000 + parts).selectExpr("id", f"IF({changed}, 'x', 'y') AS v", "id % 2 AS w")
        rows = rows.repartitionByRange(1 if kind == "one csv" else parts, "id").sortWithinPartitions("id")
        path = str(tmp_path / str(parts))
        if "csv" in kind:
            rows.write.options(header=True, maxRecordsPerFile=0 if kind == "one csv" else 400 * parts).csv(path)
            sides.append(spark.read.csv(path, header=True, schema=rows.schema))
        else:
            rows.write.parquet(path)
            sides.append(spark.read.parquet(path))
    found = {}
    for rows in (10_000_000, 2500):
        monkeypatch.setattr("twinframe.plans.pair.SLICE_ROWS", rows)
        pair = Pair(*sides, order_by=["id"] if kind == "sorted" else None)
        assert (len(pair.slices()) > 1) == (rows == 2500)
        checks = RowChecks(pair, [VALUE])
        found[rows] = sorted(map(tuple, checks.findings[0].collect()))
        assert len(checks.report().collect()) == 101
    assert found[2500] == found[10_000_000]
    assert [r[0] for r in found[2500]] == list(range(0, 7003, 3))


def test_slices_read_only_their_files(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(4000, numPartitions=8).write.parquet(path)
    side = Pair(spark.read.parquet(path), spark.read.parquet(path)).source_positions
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # its plans hide their scans
    try:
        part = side.between(600, 900)
        assert sorted(r.id for r in part.collect()) == list(range(600, 900))
        scan = part._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert scan.metrics().apply("numFiles").value() == 1


def test_staging_leaves_no_shuffled_rows(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {n for n in (disk.getAllFiles().apply(i).getName() for i in range(disk.getAllFiles().size())) if n.startswith("shuffle_")}

    before = shuffled()
    df = stage(spark.range(5000).selectExpr("id", "id % 7 AS k").repartition(3, "k"), "shuffled")
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert df.count() == 5000


def test_a_hot_key_is_combined_and_kept_whole(spark):
    source = spark.range(9000).selectExpr("IF(id % 3 = 0, 0, id) AS k", "id AS v")
    target = spark.range(9000).selectExpr("IF(id % 3 = 0, 0, id) AS k", "id + 1 AS v")
    found = by_check(validated(source, target, primary_keys="k"))
    assert found["data_validation"][0].detail == "6001 mismatches in column v"
    assert [r.source_value for r in found["duplicate_check"] if r.source_value] == ["3000"]


def test_wide_tables(spark):
    columns = [f"id + {i} AS c{i}" for i in range(150)]
    source = spark.range(50).selectExpr("id", *columns)
    target = source.withColumn("c77", source.c77 + 1).withColumn("c149", source.c149.cast("string"))
    found = by_check(validated(source, target, primary_keys="id", regression=True))
    assert {r.column for r in found["data_validation"]} == {"c77"}
    assert [r.column for r in found["metadata_type_check"] if r.result == "FAIL"] == ["c149"]


def test_custom_checks(spark):
    def rows_with_status(pair: Pair):
        n = pair.source.where("status = 'on'").count()
        return pair.spark.sql(
            f"SELECT 'status_check' AS validation, 'PASS' AS result, '' AS column, '' AS pk, '{n}' AS detail, "
            "'' AS source_value, '' AS target_value"
        )

    register_check("status", rows_with_status)
    try:
        assert by_check(validated(people(spark), people(spark), primary_keys="id"))["status_check"][0].detail == "5"
    finally:
        unregister_check("status")


def test_row_checks_see_late_rows(spark):
    source = spark.range(1000).selectExpr("id", "'a' AS v")
    target = spark.range(1000).selectExpr("id", "IF(id >= 500, 'A', 'a') AS v")
    found = by_check(validated(source, target, primary_keys="id", regression=True))
    for check in ("data_validation", "checksum_check", "case_sensitivity_check"):
        assert "FAIL" in {r.result for r in found[check]}
    with pytest.raises(TypeError):
        ValidationSpec(sample_rows=100)


def test_copies_of_a_key_are_chosen_by_value(spark):
    source = spark.createDataFrame([(1, 9), (1, 10), (2, 5)], "id int, v int")
    target = spark.createDataFrame([(1, "9"), (1, "10"), (2, "5")], "id int, v string")
    assert [r.result for r in by_check(validated(source, target, primary_keys="id"))["data_validation"]] == ["PASS"]


def test_text_sides_are_parsed_once_and_released(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("id,v\n" + "".join(f"{i},x{i}\n" for i in range(50)))
    before = named_paths()
    sides = {s: {"type": "file", "path": f"{tmp_path}/{n}.csv"} for s, n in (("source", "a"), ("target", "b"))}
    result = validate(spark, {"name": "n", "primary_keys": "id", "regression": True, **sides})
    assert "FileScan csv" not in result.df._jdf.queryExecution().executedPlan().toString()
    result = result.materialized()
    assert not result.failed() and result.staged and set(result.staged) == set(named_paths(before))
    result.close()
    assert named_paths(before) == [] and not any(os.path.exists(p) for p in result.staged)


def test_no_common_columns(spark):
    source, target = spark.range(3).toDF("a"), spark.range(3).toDF("b")
    found = by_check(validated(source, target, regression=True))
    assert found["column_count_check"][0].detail == (
        "Source: 1 columns, Target: 1 columns, Common: 0 | Source-only: ['a'] | Target-only: ['b']"
    )
    assert {r.result for rows in found.values() for r in rows} == {"PASS", "SKIP"}


def test_empty_tables(spark):
    source = people(spark)
    nothing = source.where("false")
    assert failures(validated(nothing, nothing, primary_keys="id", regression=True)) == []
    found = by_check(validated(source, nothing, primary_keys="id", regression=True))
    assert found["primary_key_match"][0].detail == "Common: 0, Source-only: 5, Target-only: 0"
    assert "data_validation" not in found


def test_untyped_nulls_and_odd_names(spark):
    source = spark.sql("SELECT id, NULL AS `a b`, id AS `c``d`, CAST(id AS STRING) AS `e'f` FROM range(4)")
    target = spark.sql("SELECT id, 'x' AS `a b`, id + 1 AS `c``d`, CAST(id AS STRING) AS `e'f` FROM range(3)")
    found = by_check(validated(source, target, primary_keys="id", regression=True))
    assert {r.column for r in found["data_validation"]} == {"a b", "c`d"}
    assert found["record_count_check"][0].result == "PASS"


def test_reduced_side_without_staging_gives_the_same_rows(spark):
    source = spark.range(200).selectExpr("id", "id % 7 AS a", "CAST(id AS STRING) AS b")
    target = spark.range(50, 500).selectExpr("id", "id % 5 AS a", "IF(id % 3 = 0, '', CAST(id AS STRING)) AS b")
    options = {"primary_keys": "id", "regression": True}
    staged = validated(source, target, **options).ordered().collect()
    assert staged == validated(source, target, stage_subset=False, **options).ordered().collect()


def test_reduced_side_with_copies_and_other_types_gives_the_same_rows_staged_and_not(spark):
    source = spark.sql(
        "SELECT IF(id % 31 = 0, NULL, id % 80) AS id, id % 5 AS a, IF(id % 4 = 0, 'Zé', concat('0', id % 6)) AS b,"
        " CAST(id % 3 AS DOUBLE) AS d, timestamp_micros(id * 86400000000) AS t, id % 2 = 0 AS `_other` FROM range(150)"
    )
    target = source.where("id IS NULL OR id > 9").selectExpr(
        "id", "IF(id % 7 = 0, 'x', CAST(a AS STRING)) AS a", "IF(id % 3 = 0, lower(b), replace(b, '0', '')) AS b",
        "IF(id % 8 = 0, NULL, d) AS d", "IF(id % 9 = 0, t + INTERVAL 1 DAY, t) AS t", "`_other` AND id % 10 <> 0 AS `_other`",
    )
    for sides in ((source, target), (target, source)):
        for columns in ("common", "all"):
            options = {"primary_keys": "id", "regression": True, "checksum_columns": columns}
            staged = validated(*sides, **options).ordered().collect()
            assert staged == validated(*sides, stage_subset=False, **options).ordered().collect()
            assert {"data_validation", "checksum_check"} <= {r.validation for r in staged if r.result == "FAIL"}


def test_rows_are_hashed_only_for_examples(spark):
    source, target = spark.range(50).selectExpr("id", "id AS a"), spark.range(50).selectExpr("id", "id + 1 AS a")
    checks = RowChecks(Pair(source, target, ["id"]), [VALUE, HASH])
    found, _ = checks.findings
    assert found.groupBy("f").count().orderBy("f").collect() == [(VALUE, 50), (HASH, 50)]
    assert found.where(f"f = {HASH} AND sv <> ''").isEmpty()
    shown = checks.report().where("validation = 'checksum_check' AND pk <> ''").orderBy("example").collect()
    assert [r.pk for r in shown] == [f"id={i}" for i in range(5)] and all(r.source_value != r.target_value for r in shown)

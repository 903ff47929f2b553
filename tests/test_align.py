import pytest

from twinframe.operators.align import (
    apply_alignment,
    common_columns,
    lower_columns,
    pick_target_keys,
    resolve_alignment,
    target_key_candidates,
)
from twinframe.sources.environments import (
    connection_settings,
    environment_profile,
    is_valid_environment,
    list_environments,
    parse_jdbc_url,
)
from twinframe.sources.tables import jdbc_options
from twinframe.spec import SuiteSpec, ValidationSpec, parse_keys


def test_common_columns_are_sorted():
    assert common_columns(["b", "a", "x"], ["a", "b", "y"]) == ["a", "b"]


def test_without_options_only_the_mapping_counts():
    found = resolve_alignment(["a", "b"], ["a", "c"], {"b": "c", "z": "a"})
    assert found.renames == {"b": "c"}
    assert found.missing == [("z", "a")]


def test_prefixes_and_suffixes():
    found = resolve_alignment(
        ["fulfill_line_id", "fulfill_line_status", "sales_amount", "note"],
        ["id", "status", "amount", "row_note"],
        {"fulfill_line_id": "id"},
        by_suffix=True,
        source_prefixes=["fulfill_line_"],
    )
    assert found.renames == {
        "fulfill_line_id": "id",
        "fulfill_line_status": "status",
        "sales_amount": "amount",
        "note": "row_note",
    }


def test_ambiguous_and_contested_names_stay():
    found = resolve_alignment(["name"], ["first_name", "last_name"], by_suffix=True)
    assert found.renames == {} and found.ambiguous == {"name": ["first_name", "last_name"]}
    found = resolve_alignment(["a_id", "b_id"], ["id"], by_suffix=True)
    assert found.renames == {} and found.contested == {"id": ["a_id", "b_id"]}


def test_equal_names_win_over_variants():
    found = resolve_alignment(["x_id", "id"], ["id"], by_suffix=True)
    assert found.renames == {"id": "id"}


def test_first_matching_prefix_is_taken_off():
    found = resolve_alignment(["item_base_peo"], ["peo"], source_prefixes=["item_", "item_base_"])
    assert found.renames == {}
    found = resolve_alignment(["item_base_peo"], ["peo"], source_prefixes=["item_base_", "item_"])
    assert found.renames == {"item_base_peo": "peo"}


def test_renaming_keeps_a_displaced_column(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    found = resolve_alignment(["a", "b"], ["b"], {"a": "b"})
    assert apply_alignment(df, found).columns == ["b", "b__source"]


def test_names_that_differ_in_case_only(spark):
    with pytest.raises(ValueError, match="case"):
        lower_columns(spark.sql("SELECT 1 AS a").selectExpr("a AS A", "a AS a"))


def test_target_key_candidates():
    options = target_key_candidates(["x_id", "k"], {"k": "key"}, ["x_"])
    assert options == [["x_id", "key"], ["x_id", "k"], ["id", "k"]]
    assert pick_target_keys(options, ["id", "k", "v"]) == ["id", "k"]
    assert pick_target_keys(options, ["v"]) is None


@pytest.mark.parametrize(
    "text, names",
    [("id,user_id", ["id", "user_id"]), ("id; user_id | status", ["id", "user_id", "status"]), ("a,", ["a"]), (" ", [])],
)
def test_key_strings(text, names):
    assert parse_keys(text) == names


def test_spec_shares_settings_and_checks_numbers():
    spec = ValidationSpec.from_dict({"sep": ";", "source": {"sep": "|"}, "target": {}, "primary_keys": "ID"})
    assert spec.source["sep"] == "|" and spec.target["sep"] == ";" and spec.primary_keys == ["id"]
    for bad in (0, -1, "x"):
        with pytest.raises(ValueError):
            ValidationSpec(quick_sample_pks=bad)


def test_suite_selection_and_overrides():
    config = {
        "validations": [
            {"name": "a", "target": {"type": "table", "table": "t"}},
            {"name": "b", "target": {"type": "file", "path": "p.csv"}},
        ]
    }
    suite = SuiteSpec.from_dict(config, target_limit=5, quick_sample_pks=3, output_dir="/out")
    assert suite.validations[0].target["limit"] == 5 and "limit" not in suite.validations[1].target
    assert [v.quick_sample_pks for v in suite.validations] == [3, 3]
    assert suite.validations[1].output_dir == "/out"
    assert [v.name for v in SuiteSpec.from_dict(config, name="b").validations] == ["b"]
    for bad in ({"config": {}}, {"config": config, "name": "z"}):
        with pytest.raises(ValueError):
            SuiteSpec.from_dict(**bad)


def test_environments():
    variables = {"DEV_JDBC_URL": "jdbc:redshift://localhost:54391/db-1", "DEV_USER": "u", "QA_JDBC_URL": "x"}
    assert parse_jdbc_url(variables["DEV_JDBC_URL"]) == {"host": "localhost", "port": 54391, "database": "db-1"}
    profile = environment_profile("dev", variables)
    assert (profile["user"], profile["password"], profile["schema"]) == ("u", "", "public")
    assert list_environments(variables) == ["DEV", "QA"]
    assert is_valid_environment("DEV", variables) and not is_valid_environment("QA", variables)
    settings = connection_settings({"environment": "DEV", "schema": "s"}, variables)
    assert settings["schema"] == "s"
    with pytest.raises(ValueError):
        connection_settings({"host": "h"}, {})
    direct = connection_settings({"host": "h", "user": "u"}, {"REDSHIFT_DB": "d"})
    assert (direct["port"], direct["database"]) == (5439, "d")


def test_jdbc_options():
    config = {"table": 't"x', "host": "h", "database": "d", "user": "u", "num_partitions": 8}
    options = jdbc_options(config, {})
    assert options["dbtable"] == '"public"."t""x"' and options["url"] == "jdbc:redshift://h:5439/d"
    assert options["numPartitions"] == "8"

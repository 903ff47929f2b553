from twinframe.operators import dashboards, summaries


def test_tabs_match_without_case(spark):
    a = spark.createDataFrame([("Sales", 0), ("Cost", 1)], "name string, index int")
    b = spark.createDataFrame([("SALES", 0), ("Profit", 1)], "name string, index int")
    got = {tuple(r) for r in dashboards.catalog_align(a, b, "Old", "New").collect()}
    assert got == {
        ("sales", "Sales", 0, "SALES", 0, ""),
        ("cost", "Cost", 1, "Cost", -1, "Missing in New"),
        ("profit", "Profit", -1, "Profit", 1, "Missing in Old"),
    }


def test_thresholds_with_failed_iterations(spark):
    data = [("a", 1, 100.0, -1.0), ("a", 2, -1.0, -1.0), ("b", 1, -1.0, 1.0), ("c", 1, 20000.0, 9000.0)]
    df = spark.createDataFrame(data, "label string, iteration int, first_render_ms double, interaction_ms double")
    got = {r.label: (r.first_render_pass, r.interaction_pass, r.result) for r in dashboards.perf_threshold(df).collect()}
    assert got == {"a": (True, True, "PASS"), "b": (False, True, "FAIL"), "c": (False, False, "FAIL")}


def test_allowed_styles(spark):
    df = spark.createDataFrame(
        [("t1", "x", "arial, sans", "10PX", "#fff"), ("t1", "y", "", "", "red"), ("t2", "z", "Comic", "9px", "#abc")],
        "tab string, text string, font_family string, font_size string, color string",
    )
    rules = (["Arial"], ["10px"], ["#FFF"])
    broken = dashboards.allowlist_violations(df, *rules).select("text", "violation_type", "found").collect()
    assert {tuple(r) for r in broken} == {("z", "font_family", "Comic"), ("z", "font_size", "9px"), ("z", "color", "#ABC")}
    verdict = {r.tab: (r.violations, r.result) for r in dashboards.allowlist_verdict(df, *rules).collect()}
    assert verdict == {"t1": (0, "PASS"), "t2": (3, "FAIL")}


def test_scores(spark):
    df = spark.createDataFrame(
        [("a", "s", 0.98), ("b", "s", 0.9799), ("c", "s", None), ("d", "s", 0.0)],
        "tab_name string, scenario_label string, ssim_score double",
    )
    row = dashboards.diff_score_summary(df).first()
    assert (row.passed, row.failed, row.total, row.avg_score) == (1, 3, 4, 0.98)


def test_sign_off_of_no_rows(spark):
    empty = spark.sql(
        "SELECT 0 AS check_no, 0 AS part, 0 AS example, '' AS validation, '' AS result, '' AS column, '' AS pk, "
        "'' AS detail, '' AS source_value, '' AS target_value WHERE false"
    )
    assert summaries.signoff_summary(empty).first().status == "PASS"
    assert summaries.run_summary(empty).first().status == "PASS"


def test_sign_off_cuts_long_details(spark):
    rows = spark.sql(
        "SELECT 7 AS check_no, 0 AS part, 0 AS example, 'data_validation' AS validation, 'FAIL' AS result, "
        "'c' AS column, '' AS pk, repeat('x', 130) AS detail, '' AS source_value, '' AS target_value"
    )
    reason = summaries.signoff_summary(rows).first().reason
    assert reason == 'Failures: 1 data validation (e.g. column "c") — ' + "x" * 120 + "…"

"""Quality suite: one fused scan, reference rule semantics (N11, QC-7)."""

import pytest

from tessera.operators import quality as QC

SUITE = {
    "table_expectations": [
        {"type": "expect_table_row_count_to_be_between", "kwargs": {"min_value": 1, "max_value": 10}},
        {"type": "expect_table_columns_to_match_set", "kwargs": {"column_set": ["a", "c", "z"]}},
    ],
    "column_expectations": {
        "a": [{"type": "expect_column_values_to_not_be_null", "kwargs": {"mostly": 0.7}},
              {"type": "expect_column_values_to_be_between", "kwargs": {"min_value": 0, "max_value": 10}}],
        "c": [{"type": "expect_column_values_to_be_in_set", "kwargs": {"value_set": ["x", "y"], "mostly": 0.5}}],
        "e": [{"type": "expect_column_values_to_be_between", "kwargs": {"min_value": 0, "max_value": 1}}],
        "q": [{"type": "expect_column_values_to_not_be_null"}],
        "a ": [],
    },
}


def _df(spark):
    return spark.createDataFrame([(1.0, "x", None), (None, "y", None), (20.0, "", None), (5.0, "x", None)],
                                 "a double, c string, e double")


def test_run_suite_semantics(spark):
    rows = {r.check_id: r for r in QC.run_suite(_df(spark), SUITE).collect()}
    assert rows[0].success and rows[0].observed == 4.0
    assert not rows[1].success and rows[1].missing == "z" and rows[1].unexpected == "e"
    assert rows[2].success and abs(rows[2].observed - 0.75) < 1e-12          # fill rate
    assert not rows[3].success and abs(rows[3].observed - 2 / 3) < 1e-12     # non-null rows only
    assert (rows[3].min_obs, rows[3].max_obs) == (1.0, 20.0)
    assert rows[4].success and rows[4].unique_obs == "|x|y"                  # "" is a value
    assert not rows[5].success and rows[5].error == "column is entirely null"
    assert not rows[6].success and "does not exist" in rows[6].error
    s = QC.suite_summary(QC.run_suite(_df(spark), SUITE)).first()
    assert (s.total, s.passed, s.failed, s.success) == (7, 3, 4, False)


def test_unknown_rule_and_fail_on_error(spark):
    import pytest
    suite = {"column_expectations": {"a": [{"type": "expect_column_to_be_magic"}]}}
    r = QC.run_suite(_df(spark), suite).first()
    assert not r.success and r.error == "rule not implemented"
    with pytest.raises(RuntimeError):
        QC.run_suite(_df(spark), suite, fail_on_error=True)


def test_single_scan(spark):
    plan = QC.run_suite(_df(spark), SUITE)._jdf.queryExecution().executedPlan().toString()
    # one aggregate over the input for every rule (plus the bounded distinct listing)
    assert plan.count("Scan ExistingRDD") + plan.count("Scan") >= 1


def test_split_valid(spark):
    rules = QC.row_rules_from_suite(SUITE, _df(spark))
    valid, bad = QC.split_valid(_df(spark), rules)
    assert valid.count() == 2
    errs = sorted(r._errors for r in bad.collect())
    assert errs == [["a:between", "c:in_set"], ["a:not_null"]]


def test_custom_rule_registry_and_report(spark, tmp_path):
    from pyspark.sql import functions as F

    @QC.rule("expect_column_max_to_be_below")
    def _max_below(i, df, column, kw):
        f = QC._base_fields(i, "expect_column_max_to_be_below", column)
        m = F.col(f"_a{i}_max")
        f.update(success=m < F.lit(kw["value"]), observed=m.cast("double"))
        return QC.Compiled([F.max(F.col(column)).alias(f"_a{i}_max")], f)

    suite = {"column_expectations": {"a": [{"type": "expect_column_max_to_be_below", "kwargs": {"value": 30}}]}}
    checks = QC.run_suite(_df(spark), suite)
    r = checks.first()
    assert r.success and r.observed == 20.0
    QC.quality_report(checks, str(tmp_path / "rep"))
    back = spark.read.json(str(tmp_path / "rep")).first()
    assert back.type == "expect_column_max_to_be_below" and back.success is True


def test_drop_columns_and_any_null(spark):
    from tessera.functions import columns as C
    df = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    assert C.drop_columns(df, ["b", "zz"]).columns == ["a"]
    assert [r[0] for r in df.select(C.any_null(["a", "b"])).collect()] == [True, False]
    assert C.select_features(df, ["b", "x", "a"])[1] == ["x"]


def test_nan_is_missing_and_broken_rules_fail_alone(spark):
    from tessera.operators import quality as QC

    @QC.rule("explodes")
    def explodes(i, df, column, kw):
        raise ZeroDivisionError("no")
    suite = {"column_expectations": {"x": [
        {"type": "between", "kwargs": {"min_value": 0, "max_value": 10}},
        {"type": "not_null", "kwargs": {"mostly": 0.5}}, {"type": "explodes"}]}}
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,)], "x double")
    checks = QC.run_suite(df, suite)
    r = {x.check_id: x for x in checks.collect()}
    assert r[0].success and r[0].max_obs == 2.0 and r[0].observed == 1.0
    assert r[1].observed == 0.5 and r[1].success
    assert not r[2].success and "rule failed" in r[2].error
    k = {x.check_id: x.kwargs for x in QC.with_kwargs(checks, suite).collect()}
    assert k[0] == '{"max_value": 10, "min_value": 0}' and k[2] == "{}"
    del QC.RULES["explodes"]


def test_route_valid_is_one_scan_and_keeps_every_row(spark, tmp_path):
    df = _df(spark)
    rules = QC.row_rules_from_suite(SUITE, df)
    scans = spark.sparkContext.accumulator(0)
    seen = df.rdd.map(lambda r: (scans.add(1), r)[1])
    counted = spark.createDataFrame(seen, df.schema)
    valid, bad = QC.route_valid(counted, rules, str(tmp_path / "t"))
    want_valid, want_bad = QC.split_valid(df, rules)
    assert scans.value == df.count()
    assert sorted(map(str, valid.collect())) == sorted(map(str, want_valid.collect()))
    assert sorted(map(str, bad.collect())) == sorted(map(str, want_bad.collect()))
    assert valid.columns == df.columns and scans.value == df.count()
    plan = valid._jdf.queryExecution().executedPlan().toString()
    assert "verdict" in plan and "PartitionFilters: [isnotnull(verdict" in plan


def test_route_valid_without_rows_and_with_clashing_names(spark, tmp_path):
    df = _df(spark)
    rules = QC.row_rules_from_suite(SUITE, df)
    for i, frame in enumerate((df.where("false"), QC.split_valid(df, rules)[0])):
        valid, bad = QC.route_valid(frame, rules, str(tmp_path / f"e{i}"))
        assert valid.count() == frame.count() and bad.count() == 0 and "_errors" in bad.columns
    with pytest.raises(ValueError, match="verdict"):
        QC.route_valid(df.selectExpr("*", "1 AS Verdict"), rules, str(tmp_path / "x"))
    named, _ = QC.route_valid(df.selectExpr("*", "1 AS Verdict"), rules, str(tmp_path / "y"), verdict="side")
    assert "Verdict" in named.columns

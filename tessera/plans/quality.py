"""Data-quality queries (QC-*) with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import quality as QC
from tessera.plans.registry import load, query
from tessera.plans.sqlgen import lit, union_all
from tessera.session import scratch_path

SEGMENTS_OK = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]
# A contract for the customer table in the reference's policy
# shape; some checks are meant to fail (missing column, unknown rule,
# segment outside the set, an absent column in the schema set).
CUSTOMER_SUITE = {
    "table_expectations": [
        {"type": "expect_table_row_count_to_be_between", "kwargs": {"min_value": 100, "max_value": 100000000}},
        {"type": "expect_table_columns_to_match_set",
         "kwargs": {"column_set": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "c_phone"]}},
    ],
    "column_expectations": {
        "c_custkey": [{"type": "expect_column_values_to_not_be_null"}],
        "c_acctbal": [
            {"type": "expect_column_values_to_not_be_null", "kwargs": {"mostly": 0.99}},
            {"type": "expect_column_values_to_be_between",
             "kwargs": {"min_value": -999.99, "max_value": 9999.99, "mostly": 0.99}},
        ],
        "c_mktsegment": [
            {"type": "expect_column_values_to_be_in_set", "kwargs": {"value_set": SEGMENTS_OK, "mostly": 0.99}},
        ],
        "c_nationkey": [
            {"type": "expect_column_values_to_be_between", "kwargs": {"min_value": 0, "max_value": 24}},
            {"type": "expect_column_values_to_be_in_set", "kwargs": {"value_set": list(range(25))}},
        ],
        "c_phone": [{"type": "expect_column_values_to_not_be_null"}],
        "c_name": [{"type": "expect_column_values_to_match_regex", "kwargs": {"regex": "^Customer"}}],
    },
}


def _row(i, rule, column, success, observed="NULL", min_obs="NULL", max_obs="NULL",
         missing="NULL", unexpected="NULL", error="NULL", unique_obs="NULL"):
    return (f"SELECT CAST({i} AS INTEGER) AS check_id, {lit(rule)} AS rule, CAST({lit(column)} AS VARCHAR) AS \"column\", "
            f"CAST({success} AS BOOLEAN) AS success, CAST({observed} AS DOUBLE) AS observed, "
            f"CAST({min_obs} AS DOUBLE) AS min_obs, CAST({max_obs} AS DOUBLE) AS max_obs, "
            f"CAST({missing} AS VARCHAR) AS missing, CAST({unexpected} AS VARCHAR) AS unexpected, "
            f"CAST({error} AS VARCHAR) AS error, CAST({unique_obs} AS VARCHAR) AS unique_obs")


def _suite_sql(suite, table, columns):
    rows = []
    for i, (name, col, kw) in enumerate(QC.iter_checks(suite)):
        if name not in QC.RULES:
            rows.append(_row(i, name, col, "FALSE", error="'rule not implemented'"))
            continue
        if col is not None and col not in columns:
            rows.append(_row(i, name, col, "FALSE", error=f"'column {col} does not exist'"))
            continue
        mostly = kw.get("mostly", 1.0)
        if name == "expect_table_row_count_to_be_between":
            n = f"(SELECT count(*) FROM {table})"
            rows.append(_row(i, name, None, f"{n} >= {kw.get('min_value', 0)} AND {n} <= {kw['max_value']}", observed=n))
        elif name == "expect_table_columns_to_match_set":
            exp = set(kw["column_set"])
            rows.append(_row(i, name, None, "TRUE" if exp == set(columns) else "FALSE",
                             missing=lit("|".join(sorted(exp - set(columns)))),
                             unexpected=lit("|".join(sorted(set(columns) - exp)))))
        elif name == "expect_column_values_to_not_be_null":
            rate = f"(SELECT 1.0 - CAST(count_if({col} IS NULL) AS DOUBLE) / count(*) FROM {table})"
            rows.append(_row(i, name, col, f"coalesce({rate} >= {mostly}, FALSE)", observed=rate))
        elif name == "expect_column_values_to_be_between":
            rate = (f"(SELECT CAST(count_if({col} IS NOT NULL AND {col} >= {kw['min_value']} AND {col} <= {kw['max_value']}) "
                    f"AS DOUBLE) / count({col}) FROM {table})")
            rows.append(_row(i, name, col, f"coalesce({rate} >= {mostly}, FALSE)", observed=rate,
                             min_obs=f"(SELECT min({col}) FROM {table})", max_obs=f"(SELECT max({col}) FROM {table})"))
        elif name == "expect_column_values_to_be_in_set":
            vals = ", ".join(lit(v) for v in kw["value_set"])
            rate = (f"(SELECT CAST(count_if({col} IS NOT NULL AND {col} IN ({vals})) AS DOUBLE) / count({col}) "
                    f"FROM {table})")
            uniq = (f"(SELECT string_agg(CAST(v AS VARCHAR), '|' ORDER BY v) FROM "
                    f"(SELECT DISTINCT {col} AS v FROM {table} WHERE {col} IS NOT NULL ORDER BY v LIMIT 10) u)")
            rows.append(_row(i, name, col, f"coalesce({rate} >= {mostly}, FALSE)", observed=rate, unique_obs=uniq))
    return union_all(rows)


CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query("qc08_run_suite", _suite_sql(CUSTOMER_SUITE, "customer", CUSTOMER_COLUMNS))
def run_suite(spark, sf):
    """QC-1..10: every rule of the suite fused into one aggregate scan."""
    return QC.run_suite(load(spark, sf, "customer"), CUSTOMER_SUITE)


@query("qc08_suite_summary", f"""
SELECT count(*) AS total, CAST(count_if(success) AS BIGINT) AS passed,
       CAST(count_if(NOT success) AS BIGINT) AS failed, count_if(NOT success) = 0 AS success
FROM ({_suite_sql(CUSTOMER_SUITE, "customer", CUSTOMER_COLUMNS)}) s
""")
def suite_summary(spark, sf):
    return QC.suite_summary(QC.run_suite(load(spark, sf, "customer"), CUSTOMER_SUITE))


ORDER_SUITE = {
    "column_expectations": {
        "o_totalprice": [{"type": "expect_column_values_to_be_between", "kwargs": {"min_value": 0, "max_value": 450000}}],
        "o_orderstatus": [{"type": "expect_column_values_to_be_in_set", "kwargs": {"value_set": ["F", "O"]}}],
        "o_orderpriority": [{"type": "expect_column_values_to_not_be_null"}],
    }
}


SPLIT_SQL = """
SELECT o_orderkey, errors, errors = '' AS is_valid FROM (
  SELECT o_orderkey, concat_ws('|',
    CASE WHEN NOT (o_totalprice IS NULL OR (o_totalprice >= 0 AND o_totalprice <= 450000)) THEN 'o_totalprice:between' END,
    CASE WHEN NOT (o_orderstatus IS NULL OR o_orderstatus IN ('F', 'O')) THEN 'o_orderstatus:in_set' END,
    CASE WHEN o_orderpriority IS NULL THEN 'o_orderpriority:not_null' END) AS errors
  FROM orders) t
"""


@query("qc11_split_valid", SPLIT_SQL)
def split_valid(spark, sf):
    """QC-11: row-level tagging with the suite's predicates; valid rows are
    those with no error (``split_valid`` returns both sides)."""
    o = load(spark, sf, "orders")
    rules = QC.row_rules_from_suite(ORDER_SUITE, o)
    tagged = QC.with_errors(o, rules)
    return tagged.select("o_orderkey", F.array_join("_errors", "|").alias("errors"),
                         (F.size("_errors") == 0).alias("is_valid"))


@query("qc11_routed_split", SPLIT_SQL)
def routed_split(spark, sf):
    """QC-11 as a sink: both sides from one scan and one write, read back."""
    o = load(spark, sf, "orders")
    valid, bad = QC.route_valid(o, QC.row_rules_from_suite(ORDER_SUITE, o), scratch_path(spark, "routed"))
    return valid.select("o_orderkey", F.lit("").alias("errors"), F.lit(True).alias("is_valid")).unionAll(
        bad.select("o_orderkey", F.array_join("_errors", "|").alias("errors"), F.lit(False).alias("is_valid")))

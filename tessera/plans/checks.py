"""Queries of operators that the other modules only use inside larger ones,
each with its DuckDB twin."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import metrics as MT
from tessera.operators import profile as PR
from tessera.operators import quality as QC
from tessera.operators import sample as SA
from tessera.plans.metrics import SCORED_SQL, scored_events
from tessera.plans.registry import load, query
from tessera.session import scratch_path
from tessera.sources import files as IO


@query("io02_na_tokens", """
SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN NULL WHEN c_nationkey % 3 = 1 THEN '' ELSE c_mktsegment END AS segment
FROM customer
""")
def na_tokens(spark, sf):
    """IO-2: string cells that spell a missing value become null, blanks stay."""
    path = scratch_path(spark, "na-tokens")
    c = load(spark, sf, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 3 == 0, "N/A").when(
        F.col("c_nationkey") % 3 == 1, "").otherwise(F.col("c_mktsegment")).alias("segment"))
    c.write.option("header", "true").option("emptyValue", "").csv(path)
    tokens = [t for t in IO.PANDAS_NA_TOKENS if t]
    return IO.read_csv(spark, path, "c_custkey bigint, segment string", null_tokens=tokens)


@query("io09_from_records", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice IS NOT NULL "
                            "ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def from_records(spark, sf):
    """IO-9: a few collected records as a table again."""
    top = SA.top_k(load(spark, sf, "orders"), 20, "o_totalprice", "o_orderkey").collect()
    return IO.from_records(spark, [r.asDict() for r in top], "o_orderkey bigint, o_totalprice double")


@query("pf02_drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def drop_columns(spark, sf):
    o = load(spark, sf, "orders")
    return C.drop_columns(o, [*[c for c in o.columns if c not in ("o_orderkey", "o_custkey", "o_orderstatus")], "absent"])


@query("pf09_any_null", """
SELECT l_linestatus, count(*) FILTER (WHERE nullif(l_discount, 0) IS NULL OR nullif(l_tax, 0) IS NULL) AS n_null, count(*) AS n
FROM lineitem GROUP BY l_linestatus
""")
def any_null(spark, sf):
    li = load(spark, sf, "lineitem").select("l_linestatus", F.nullif("l_discount", F.lit(0.0)).alias("a"),
                                            F.nullif("l_tax", F.lit(0.0)).alias("b"))
    return li.groupBy("l_linestatus").agg(F.count_if(C.any_null(["a", "b"])).alias("n_null"), F.count(F.lit(1)).alias("n"))


@query("fe03_ratio_null", """
SELECT l_linestatus, count(l_quantity / nullif(l_discount, 0)) AS n, avg(l_quantity / nullif(l_discount, 0)) AS mean_ratio
FROM lineitem GROUP BY l_linestatus
""")
def ratio_null(spark, sf):
    """FE-3: a zero denominator gives null."""
    r = C.ratio_expr("l_quantity", "l_discount", zero_policy="null")
    return load(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.count(r).alias("n"), F.avg(r).alias("mean_ratio"))


@query("fe07_factorize_alpha", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS code FROM orders
""")
def factorize_alpha(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return C.factorize(o, "o_orderpriority", key="o_orderkey", new_col="code", order="alpha") \
        .select("o_orderkey", F.col("code").cast("long").alias("code"))


@query("mt04_pr_curve", f"""
WITH g AS (SELECT prob AS threshold, count_if(label = 1) AS pos, count(*) AS n FROM {SCORED_SQL} s WHERE prob IS NOT NULL GROUP BY prob),
c AS (SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(n) OVER (ORDER BY threshold DESC) AS k,
             sum(pos) OVER () AS p FROM g)
SELECT threshold, CAST(tp AS DOUBLE) / k AS precision, CAST(tp AS DOUBLE) / p AS recall FROM c
""")
def pr_curve(spark, sf):
    return MT.pr_curve(scored_events(spark, sf), "prob", "label", rows_per_bucket=4096)


@query("sl02_sort_by", """
SELECT value, count, rank FROM (
  SELECT o_orderstatus AS value, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC) AS rank FROM orders GROUP BY 1) t
""")
def sort_by(spark, sf):
    """SL-2: a result table in order, the order written down as a rank."""
    counts = SA.sort_by(PR.value_counts(load(spark, sf, "orders"), "o_orderstatus"), "count").collect()  # one row per status
    rows = [(r["value"], r["count"], i + 1) for i, r in enumerate(counts)]
    return spark.createDataFrame(rows, "value string, count long, rank long")


SUITE = {
    "table_expectations": [{"type": "expect_table_row_count_to_be_between", "kwargs": {"min_value": 1}}],
    "column_expectations": {
        "o_orderkey": [{"type": "expect_column_values_to_not_be_null", "kwargs": {"mostly": 0.99}}],
        "o_totalprice": [{"type": "expect_column_values_to_be_between", "kwargs": {"min_value": 0, "max_value": 200000}}]},
}


def _report_sql() -> str:
    rate = "count(*) FILTER (WHERE o_totalprice BETWEEN 0 AND 200000) * 1.0 / count(o_totalprice)"
    seen = ["count(*) * 1.0", "count(o_orderkey) * 1.0 / count(*)", rate]
    good = ["count(*) >= 1", "count(o_orderkey) * 1.0 / count(*) >= 0.99", f"{rate} >= 1"]
    parts = []
    for i, (name, column, kwargs) in enumerate(QC.iter_checks(SUITE)):
        parts.append(f"SELECT '{name}' AS type, {repr(column) if column else 'NULL'} AS \"column\", {good[i]} AS success, "
                     f"CAST({seen[i]} AS DOUBLE) AS observed, '{json.dumps(kwargs, sort_keys=True)}' AS kwargs FROM orders")
    return "\nUNION ALL ".join(parts)


@query("qc10_quality_report", _report_sql())
def quality_report(spark, sf):
    """QC-10: the report with the rules' parameters, written and read back."""
    path = scratch_path(spark, "quality-report")
    QC.quality_report(QC.run_suite(load(spark, sf, "orders"), SUITE), path, suite=SUITE)
    schema = "type string, `column` string, success boolean, observed double, kwargs string"
    return spark.read.schema(schema).json(path)

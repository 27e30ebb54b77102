"""Feature engineering, projection and imputation queries (FE-*, PF-*,
IS-*) with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import impute as IM
from tessera.operators.features import feature_pipeline, fit_categories, scoring_features
from tessera.plans.eda import MISSING_SQL, NUM, lineitem_with_missing
from tessera.plans.registry import load, query
from tessera.plans.sqlgen import cut_case

# The feature policy applied to lineitem (mirrors the shape of
# the reference's preprocessing policy).
FEATURE_CONFIG = {
    "binary_flags": [
        {"column": "l_quantity", "value": 25, "new_column": "is_bulk"},
        {"column": "l_discount", "value": 0.05, "new_column": "is_discounted"},
        {"column": "l_weight", "value": 10, "new_column": "is_heavy"},  # absent -> skipped
    ],
    "ratio_features": [
        {"name": "price_per_unit", "numerator": "l_extendedprice", "denominator": "l_quantity"},
        {"name": "tax_discount_ratio", "numerator": "l_tax", "denominator": "l_discount"},
    ],
    "log_transform": {"columns": ["l_extendedprice"]},
    "polynomial_features": [{"name": "qty_x_discount", "columns": ["l_quantity", "l_discount"]}],
    "categorical_encoding": {"columns": ["l_linestatus", "l_returnflag"], "one_hot_prefix": "cat",
                             "mappings": {"l_linestatus": {"O": 0, "F": 1}}},
    "target": {"column": "l_returnflag", "mapping": {"R": 1, "A": 0, "N": 0}, "name": "target_numeric"},
    "features_to_keep": ["l_orderkey", "l_linenumber", "l_quantity", "is_bulk", "is_discounted",
                         "is_heavy", "price_per_unit", "tax_discount_ratio", "log_l_extendedprice",
                         "qty_x_discount", "l_linestatus_encoded", "cat_l_linestatus_F",
                         "cat_l_linestatus_O", "cat_l_returnflag_A", "cat_l_returnflag_N",
                         "cat_l_returnflag_R", "target_numeric"],
}

FEATURE_SQL = """
SELECT l_orderkey, l_linenumber, l_quantity,
  coalesce(CAST(l_quantity > 25 AS INTEGER), 0) AS is_bulk,
  coalesce(CAST(l_discount > 0.05 AS INTEGER), 0) AS is_discounted,
  CAST(l_extendedprice AS DOUBLE) / CAST(CASE WHEN l_quantity = 0 THEN 0.001 ELSE l_quantity END AS DOUBLE) AS price_per_unit,
  CAST(l_tax AS DOUBLE) / CAST(CASE WHEN l_discount = 0 THEN 0.001 ELSE l_discount END AS DOUBLE) AS tax_discount_ratio,
  ln(1 + CASE WHEN l_extendedprice < 0 THEN 0.0 ELSE l_extendedprice END) AS log_l_extendedprice,
  l_quantity * l_discount AS qty_x_discount,
  CAST(coalesce(CASE l_linestatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 END, -1) AS INTEGER) AS l_linestatus_encoded,
  coalesce(CAST(l_linestatus = 'F' AS INTEGER), 0) AS cat_l_linestatus_F,
  coalesce(CAST(l_linestatus = 'O' AS INTEGER), 0) AS cat_l_linestatus_O,
  coalesce(CAST(l_returnflag = 'A' AS INTEGER), 0) AS cat_l_returnflag_A,
  coalesce(CAST(l_returnflag = 'N' AS INTEGER), 0) AS cat_l_returnflag_N,
  coalesce(CAST(l_returnflag = 'R' AS INTEGER), 0) AS cat_l_returnflag_R,
  CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 0 END AS target_numeric
FROM lineitem
"""


@query("fe13_feature_table", FEATURE_SQL)
def feature_table(spark, sf):
    """FE-1..6, FE-8, PF-1, PF-4 chained as one projection (FE-13)."""
    return feature_pipeline(load(spark, sf, "lineitem"), FEATURE_CONFIG)


@query("fe07_factorize", """
WITH d AS (SELECT o_orderpriority AS v, min(o_orderkey) AS f FROM orders
           WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority),
r AS (SELECT v, row_number() OVER (ORDER BY f) - 1 AS code FROM d)
SELECT o.o_orderkey, o.o_orderpriority, CAST(coalesce(r.code, -1) AS INTEGER) AS o_orderpriority_encoded
FROM orders o LEFT JOIN r ON o.o_orderpriority = r.v
""")
def factorize(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return C.factorize(o, "o_orderpriority", key="o_orderkey")


@query("fe07_factorize_frequency", """
WITH d AS (SELECT o_orderstatus AS v, count(*) AS n FROM orders
           WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus),
r AS (SELECT v, row_number() OVER (ORDER BY n DESC, v) - 1 AS code FROM d)
SELECT o.o_orderkey, o.o_orderstatus, CAST(coalesce(r.code, -1) AS INTEGER) AS o_orderstatus_encoded
FROM orders o LEFT JOIN r ON o.o_orderstatus = r.v
""")
def factorize_frequency(spark, sf):
    """FE-7 with codes by descending frequency (ties alphabetical)."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return C.factorize(o, "o_orderstatus", key="o_orderkey", order="frequency")


@query("fe08_one_hot", """
SELECT o_orderkey,
  coalesce(CAST(o_orderstatus = 'F' AS INTEGER), 0) AS cat_o_orderstatus_F,
  coalesce(CAST(o_orderstatus = 'O' AS INTEGER), 0) AS cat_o_orderstatus_O,
  coalesce(CAST(o_orderstatus = 'P' AS INTEGER), 0) AS cat_o_orderstatus_P
FROM orders
""")
def one_hot(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return C.one_hot(o, "o_orderstatus").drop("o_orderstatus")


# Order price bins.
PRICE_CUTS = [0, 50000, 100000, 200000, 300000, 450000]
PRICE_LABELS = ["p0_50k", "p50_100k", "p100_200k", "p200_300k", "p300_450k"]


@query("fe10_cut", f"""
SELECT o_orderkey, {cut_case("o_totalprice", PRICE_CUTS, PRICE_LABELS)} AS price_bin,
       CAST({cut_case("o_totalprice", PRICE_CUTS)} AS INTEGER) AS price_bin_ord
FROM orders
""")
def cut_bins(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return C.cut(o, "o_totalprice", PRICE_CUTS, PRICE_LABELS, new_col="price_bin").drop("o_totalprice")


def _qcut_sql(cols, q=4):
    probs = ", ".join(str(i / q) for i in range(q + 1))
    edges = ", ".join(f"list_sort(list_distinct(quantile_cont({c}, [{probs}]))) AS e_{c}" for c in cols)
    sel = []
    for c in cols:
        e = f"e_{c}"
        b = (f"CASE WHEN {c} IS NULL OR {c} < {e}[1] OR {c} > {e}[len({e})] THEN NULL "
             f"ELSE CAST(greatest(len(list_filter({e}, lambda x: x < {c})) - 1, 0) AS INTEGER) END")
        sel += [f"{b} AS {c}_bin", f"{e}[({b}) + 1] AS {c}_bin_lo", f"{e}[({b}) + 2] AS {c}_bin_hi"]
    return f"""WITH e AS (SELECT {edges} FROM lineitem)
SELECT l_orderkey, l_linenumber, {", ".join(sel)} FROM lineitem, e"""


QCUT_COLS = ["l_quantity", "l_extendedprice"]


@query("fe11_qcut", _qcut_sql(QCUT_COLS))
def qcut(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *QCUT_COLS)
    return C.qcut(li, QCUT_COLS, 4).drop(*QCUT_COLS)


# ------------------------------------------------------------ projections --

@query("pf05_conform", """
SELECT l_orderkey, l_quantity, CAST(0 AS INTEGER) AS l_weight, l_discount FROM lineitem
WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL
""")
def conform(spark, sf):
    """PF-3 / PF-5 / PF-6: numeric selection, conform to a fixed column list
    (absent column -> 0) and complete-case filter."""
    li = load(spark, sf, "lineitem")
    num = C.select_by_type(li, "numeric")
    d = C.conform(li.select(*num), ["l_orderkey", "l_quantity", "l_weight", "l_discount"], fill=0)
    return C.drop_nulls(d, ["l_quantity", "l_discount"])


@query("pf11_risk_factors", """
SELECT o_orderkey,
  CASE WHEN o_totalprice >= 300000 THEN 1 ELSE 0 END AS decision,
  CASE WHEN len(list_filter([CASE WHEN o_totalprice > 250000 THEN 'high value' END,
                             CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END,
                             CASE WHEN o_orderstatus IN ('O', 'P') THEN 'open' END], lambda x: x IS NOT NULL)) = 0
       THEN 'no risk factor'
       ELSE array_to_string(list_filter([CASE WHEN o_totalprice > 250000 THEN 'high value' END,
                             CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END,
                             CASE WHEN o_orderstatus IN ('O', 'P') THEN 'open' END], lambda x: x IS NOT NULL), '|') END AS factors
FROM orders
""")
def risk_factors(spark, sf):
    """PF-10 decision (``>=`` threshold) and PF-11 rule messages."""
    o = load(spark, sf, "orders")
    rules = [("high value", F.col("o_totalprice") > 250000),
             ("urgent", F.col("o_orderpriority") == "1-URGENT"),
             ("open", C.is_in("o_orderstatus", ["O", "P"]))]
    return o.select("o_orderkey",
                    C.decide("o_totalprice", 300000).alias("decision"),
                    F.array_join(C.risk_factors(rules), "|").alias("factors"))


# -------------------------------------------------------------- imputation --

KEYS = ["l_orderkey", "l_linenumber"]


@query("is01_impute_constant", f"SELECT l_orderkey, l_linenumber, coalesce(l_tax, -1.0) AS l_tax FROM {MISSING_SQL} t")
def impute_constant(spark, sf):
    d = lineitem_with_missing(spark, sf).select(*KEYS, "l_tax")
    return IM.impute_constant(d, ["l_tax"], -1.0)


@query("is02_impute_median", f"""
SELECT l_orderkey, l_linenumber, coalesce(l_discount, (SELECT median(l_discount) FROM {MISSING_SQL} a)) AS l_discount,
       coalesce(l_tax, (SELECT median(l_tax) FROM {MISSING_SQL} b)) AS l_tax FROM {MISSING_SQL} t
""")
def impute_median(spark, sf):
    d = lineitem_with_missing(spark, sf).select(*KEYS, "l_discount", "l_tax")
    return IM.impute_median(d, ["l_discount", "l_tax"])


def _mode_sql(c):
    return (f"(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM {MISSING_SQL} m WHERE {c} IS NOT NULL "
            f"GROUP BY {c}) g ORDER BY n DESC, v ASC LIMIT 1)")


@query("is03_impute_mode", f"""
SELECT l_orderkey, l_linenumber, coalesce(l_discount, {_mode_sql('l_discount')}) AS l_discount,
       coalesce(l_tax, {_mode_sql('l_tax')}) AS l_tax FROM {MISSING_SQL} t
""")
def impute_mode(spark, sf):
    d = lineitem_with_missing(spark, sf).select(*KEYS, "l_discount", "l_tax")
    return IM.impute_mode(d, ["l_discount", "l_tax"])


@query("is04_impute_group_median", f"""
SELECT t.l_orderkey, t.l_linenumber, t.l_returnflag, coalesce(t.l_discount, g.m) AS l_discount
FROM {MISSING_SQL} t LEFT JOIN (SELECT l_returnflag, median(l_discount) AS m FROM {MISSING_SQL} x
                                WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag) g
  ON t.l_returnflag = g.l_returnflag
""")
def impute_group_median(spark, sf):
    d = lineitem_with_missing(spark, sf).select(*KEYS, "l_returnflag", "l_discount")
    return IM.impute_group_median(d, "l_returnflag", "l_discount")


def _std_sql(ddof, eps):
    sd = "stddev_samp" if ddof == 1 else "stddev_pop"
    stats = ", ".join(f"avg({c}) AS m_{c}, {sd}({c}) AS s_{c}" for c in NUM)
    sel = ", ".join(f"({c} - m_{c}) / (s_{c} + {eps!r}) AS {c}" for c in NUM)
    return f"SELECT l_orderkey, l_linenumber, {sel} FROM {MISSING_SQL} t, (SELECT {stats} FROM {MISSING_SQL} x) s"


@query("is05_standardize", _std_sql(1, 1e-9))
def standardize(spark, sf):
    d = lineitem_with_missing(spark, sf).select(*KEYS, *NUM)
    return IM.standardize(d, NUM, ddof=1, eps=1e-9)


@query("is06_standardize_pop", _std_sql(0, 0.0))
def standardize_pop(spark, sf):
    d = lineitem_with_missing(spark, sf).select(*KEYS, *NUM)
    return IM.standardize(d, NUM, ddof=0, eps=0.0)


@query("is07_robust_scale", f"""
SELECT l_orderkey, l_linenumber, {", ".join(
    f"({c} - quantile_cont_{c}[2]) / CASE WHEN quantile_cont_{c}[3] - quantile_cont_{c}[1] = 0 THEN 1.0 "
    f"ELSE quantile_cont_{c}[3] - quantile_cont_{c}[1] END AS {c}" for c in NUM)}
FROM {MISSING_SQL} t, (SELECT {", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS quantile_cont_{c}" for c in NUM)}
                       FROM {MISSING_SQL} x) q
""")
def robust_scale(spark, sf):
    d = lineitem_with_missing(spark, sf).select(*KEYS, *NUM)
    return IM.robust_scale(d, NUM)


SCORING_SQL = FEATURE_SQL.replace(
    "  CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 0 END AS target_numeric\n",
    "  CAST(0 AS INTEGER) AS is_heavy\n")


@query("fe14_scoring_features", SCORING_SQL)
def scoring(spark, sf):
    """FE-14: the training pipeline's code path on raw records with the
    categories fitted at training time; a flag whose source column is absent
    becomes 0 and the output is conformed to the training column order."""
    li = load(spark, sf, "lineitem")
    fitted = fit_categories(li, FEATURE_CONFIG)
    return scoring_features(li, FEATURE_CONFIG, fitted)

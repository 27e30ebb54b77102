"""EDA queries (AG-*) on the driver tables, each with its DuckDB twin.

Mapping to the reference's patient table: ``lineitem`` plays the wide
numeric table (label = returned line ``l_returnflag = 'R'``), ``orders``
the categorical one.  A zero discount / tax is treated as "not recorded"
to obtain real nulls for the null-handling operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.columns import cut, label_from_map
from tessera.operators import gram as GR
from tessera.operators import pivot as PV
from tessera.operators import profile as PR
from tessera.operators import stats as ST
from tessera.plans.registry import load, query
from tessera.plans.sqlgen import cut_case, union_all

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# Quantity bins (right-closed, lowest included) and labels.
QTY_CUTS = [0, 10, 20, 30, 40, 50]
QTY_LABELS = ["q00_10", "q10_20", "q20_30", "q30_40", "q40_50"]
RETURN_MAP = {"R": 1, "A": 0, "N": 0}

LABELED_SQL = ("(SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_returned "
               "FROM lineitem)")
MISSING_SQL = ("(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
               "nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax, l_returnflag, "
               "l_linestatus, l_shipdate FROM lineitem)")


def lineitem_labeled(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.withColumn("is_returned", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))


def lineitem_with_missing(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.withColumns({"l_discount": F.nullif(F.col("l_discount"), F.lit(0.0)),
                           "l_tax": F.nullif(F.col("l_tax"), F.lit(0.0))})


# ------------------------------------------------------------- flagship --

PIVOT_SQL = f"""
SELECT l_linestatus,
  {", ".join(f"avg(CASE WHEN qty_bin = '{lb}' THEN label END) AS {lb}" for lb in QTY_LABELS)}
FROM (SELECT l_linestatus,
        CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 0 END AS label,
        {cut_case("l_quantity", QTY_CUTS, QTY_LABELS)} AS qty_bin
      FROM lineitem) t
WHERE l_linestatus IS NOT NULL AND qty_bin IS NOT NULL
GROUP BY l_linestatus
"""


@query("ag10_pivot_label_rate", PIVOT_SQL)
def pivot_label_rate(spark, sf):
    """Label rate by category x binned number (IO-4 -> PF-1 -> FE-10 -> AG-10)."""
    li = load(spark, sf, "lineitem").select("l_linestatus", "l_returnflag", "l_quantity")
    d = li.withColumn("label", label_from_map("l_returnflag", RETURN_MAP))
    d = cut(d, "l_quantity", QTY_CUTS, QTY_LABELS, new_col="qty_bin")
    return PV.pivot_mean(d, "l_linestatus", "qty_bin", "label", values=QTY_LABELS)


@query("pf12_round_pivot", f"""
SELECT l_linestatus, {", ".join(f"round_even({lb}, 4) AS {lb}" for lb in QTY_LABELS)}
FROM ({PIVOT_SQL}) p
""")
def round_pivot(spark, sf):
    """PF-12: result tables rounded half-to-even to 4 places (pandas)."""
    from tessera.functions.columns import round_half_even
    p = pivot_label_rate(spark, sf)
    return p.select("l_linestatus", *[round_half_even(lb, 4).alias(lb) for lb in QTY_LABELS])


# ----------------------------------------------------------- profiling --

@query("ag01_table_profile", union_all([
    f"SELECT {i} AS position, '{c}' AS \"column\", CAST(count_if({c} IS NULL) AS BIGINT) AS n_missing, count(*) AS n_rows FROM {MISSING_SQL} t"
    for i, c in enumerate(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                           "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"])]))
def table_profile(spark, sf):
    return PR.table_profile(lineitem_with_missing(spark, sf))


@query("ag02_describe", union_all([
    f"SELECT '{c}' AS feature, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
    f"min({c}) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, "
    f"quantile_cont({c}, 0.75) AS p75, max({c}) AS max, skewness({c}) AS skewness FROM {MISSING_SQL} t"
    for c in NUM]))
def describe(spark, sf):
    return PR.describe(lineitem_with_missing(spark, sf), NUM)


@query("ag03_value_counts", """
SELECT o_orderpriority AS value, count(*) AS count,
       CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority
""")
def value_counts(spark, sf):
    return PR.value_counts(load(spark, sf, "orders"), "o_orderpriority")


@query("ag04_missing_loss", f"""
SELECT count(*) AS n_rows,
       CAST(count_if(l_quantity IS NULL OR l_extendedprice IS NULL OR l_discount IS NULL OR l_tax IS NULL) AS BIGINT) AS n_with_null,
       CAST(count(*) - count_if(l_quantity IS NULL OR l_extendedprice IS NULL OR l_discount IS NULL OR l_tax IS NULL) AS BIGINT) AS n_remaining,
       count_if(l_quantity IS NULL OR l_extendedprice IS NULL OR l_discount IS NULL OR l_tax IS NULL) * 100.0 / count(*) AS loss_pct
FROM {MISSING_SQL} t
""")
def missing_loss(spark, sf):
    return PR.missing_loss(lineitem_with_missing(spark, sf), NUM)


@query("ag05_histogram", """
WITH mm AS (SELECT min(o_totalprice) AS mn, max(o_totalprice) AS mx FROM orders),
b AS (SELECT CAST(least(floor((o_totalprice - mn) * CAST(30 AS DOUBLE) / (mx - mn)), 29) AS INTEGER) AS bin, mn, mx
      FROM orders, mm WHERE o_totalprice IS NOT NULL)
SELECT bin, mn + bin * ((mx - mn) / CAST(30 AS DOUBLE)) AS lo, mn + (bin + 1) * ((mx - mn) / CAST(30 AS DOUBLE)) AS hi,
       count(*) AS count
FROM b GROUP BY bin, mn, mx
""")
def histogram(spark, sf):
    return PR.histogram(load(spark, sf, "orders"), "o_totalprice", 30)


@query("ag06_box_stats", """
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS med,
                  quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem),
f AS (SELECT q1, med, q3, q3 - q1 AS iqr, q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) AS lo,
             q3 + CAST(1.5 AS DOUBLE) * (q3 - q1) AS hi FROM q)
SELECT 'l_extendedprice' AS feature, q1, med AS median, q3, iqr, lo AS lo_fence, hi AS hi_fence,
       min(CASE WHEN l_extendedprice >= lo AND l_extendedprice <= hi THEN l_extendedprice END) AS whisker_lo,
       max(CASE WHEN l_extendedprice >= lo AND l_extendedprice <= hi THEN l_extendedprice END) AS whisker_hi,
       CAST(count_if(l_extendedprice IS NOT NULL AND NOT (l_extendedprice >= lo AND l_extendedprice <= hi)) AS BIGINT) AS n_outliers
FROM lineitem, f GROUP BY q1, med, q3, iqr, lo, hi
""")
def box_stats(spark, sf):
    return PR.box_stats(load(spark, sf, "lineitem"), "l_extendedprice")


@query("ag07_correlation_matrix", union_all([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS corr FROM lineitem"
    for a in NUM for b in NUM]))
def correlation_matrix(spark, sf):
    return PR.correlation_matrix(load(spark, sf, "lineitem"), NUM)


@query("ag07_correlation_wide", """
WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i
           FROM embeddings)
SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, corr(a.x, b.x) AS r
FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2
""")
def correlation_wide(spark, sf):
    """AG-7 over the elements of an array column: all pairs from one pass."""
    return GR.correlation_cells(load(spark, sf, "embeddings"), "embedding").withColumnRenamed("corr", "r")


@query("ag08_correlation_with", union_all([
    f"SELECT '{c}' AS feature, corr(CAST({c} AS DOUBLE), CAST(is_returned AS DOUBLE)) AS corr FROM {LABELED_SQL} t"
    for c in NUM + ["is_returned"]]))
def correlation_with(spark, sf):
    return PR.correlation_with(lineitem_labeled(spark, sf), "is_returned", NUM)


@query("ag09_group_mean", """
SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS mean, count(o_totalprice) AS n
FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL
GROUP BY o_orderstatus, o_orderpriority
""")
def group_mean(spark, sf):
    return PV.group_mean(load(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice")


@query("ag11_interaction_curve", f"""
SELECT qty_bin, l_linestatus, l_returnflag, avg(l_discount) AS mean, count(l_discount) AS n,
       stddev_samp(l_discount) AS std,
       avg(l_discount) - 1.959963984540054 * stddev_samp(l_discount) / sqrt(CAST(count(l_discount) AS DOUBLE)) AS ci_lo,
       avg(l_discount) + 1.959963984540054 * stddev_samp(l_discount) / sqrt(CAST(count(l_discount) AS DOUBLE)) AS ci_hi
FROM (SELECT *, {cut_case("l_quantity", QTY_CUTS, QTY_LABELS)} AS qty_bin FROM lineitem) t
WHERE qty_bin IS NOT NULL AND l_linestatus IS NOT NULL AND l_returnflag IS NOT NULL
GROUP BY qty_bin, l_linestatus, l_returnflag
""")
def interaction_curve(spark, sf):
    d = cut(load(spark, sf, "lineitem"), "l_quantity", QTY_CUTS, QTY_LABELS, new_col="qty_bin")
    return PV.interaction_curve(d, "qty_bin", "l_linestatus", "l_returnflag", "l_discount")


@query("ag12_crosstab", """
SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders
WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY o_orderstatus, o_orderpriority
""")
def crosstab(spark, sf):
    return PR.crosstab(load(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


def _anova_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature,
  CASE WHEN k - 1 > 0 AND N - k > 0 AND ssw > 0 THEN (ssb / (k - 1)) / (ssw / (N - k)) END AS f_stat,
  CAST(k - 1 AS DOUBLE) AS df_between, CAST(N - k AS DOUBLE) AS df_within
FROM (SELECT CAST(sum(n) AS DOUBLE) AS N, CAST(count(*) AS DOUBLE) AS k,
             sum(n * pow(m - grand, 2)) AS ssb, sum((n - 1) * coalesce(v, 0)) AS ssw
      FROM (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS grand
            FROM (SELECT count({c}) AS n, avg({c}) AS m, var_samp({c}) AS v FROM lineitem
                  WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag) g WHERE n > 0) g2) p"""


@query("ag13_anova_f", union_all([_anova_sql(c) for c in NUM]))
def anova_f(spark, sf):
    """F statistic only (exact twin); ``ag13_anova`` adds the p-value."""
    return ST.anova_f(load(spark, sf, "lineitem"), NUM, "l_returnflag")


# three groups: with two degrees of freedom the tail of F has a closed form
@query("ag13_anova", f"""
SELECT *, p_value < 0.05 AS significant
FROM (SELECT *, pow(1 + 2 * f_stat / df_within, -df_within / 2) AS p_value FROM ({union_all([_anova_sql(c) for c in NUM])}) f) p
""")
def anova(spark, sf):
    return ST.anova_oneway(load(spark, sf, "lineitem"), NUM, "l_returnflag")


CHI_PAIRS = [("l_returnflag", "l_linestatus"), ("l_linestatus", "qty_class")]
CHI_BASE_SQL = "(SELECT *, CASE WHEN l_quantity > 25 THEN 'bulk' ELSE 'small' END AS qty_class FROM lineitem)"
CHI_SQL = f"""
WITH cells AS ({union_all([
    f"SELECT '{a} x {b}' AS pair, CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, count(*) AS o "
    f"FROM {CHI_BASE_SQL} t WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2, 3" for a, b in CHI_PAIRS])}),
m AS (SELECT pair, a, b, CAST(o AS DOUBLE) AS o,
             CAST(sum(o) OVER (PARTITION BY pair, a) AS DOUBLE) AS r,
             CAST(sum(o) OVER (PARTITION BY pair, b) AS DOUBLE) AS c,
             CAST(sum(o) OVER (PARTITION BY pair) AS DOUBLE) AS N FROM cells),
e AS (SELECT *, r * c / N AS e FROM m),
rs AS (SELECT pair, count(*) AS R, sum(1 / r) AS inv_r FROM (SELECT DISTINCT pair, a, r FROM e) x GROUP BY pair),
cs AS (SELECT pair, count(*) AS C, sum(1 / c) AS inv_c FROM (SELECT DISTINCT pair, b, c FROM e) x GROUP BY pair),
ag AS (SELECT pair, max(N) AS N, sum(o * o / e) AS s, max(abs(o - e)) AS d FROM e GROUP BY pair)
SELECT ag.pair,
       CASE WHEN (R - 1) * (C - 1) = 1 THEN pow(greatest(d - 0.5, 0), 2) * N * inv_r * inv_c
            ELSE greatest(s - N, 0) END AS chi2,
       CAST((R - 1) * (C - 1) AS BIGINT) AS dof, CAST(N AS BIGINT) AS n
FROM ag JOIN rs ON ag.pair = rs.pair JOIN cs ON ag.pair = cs.pair
"""


def _chi_base(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.withColumn("qty_class", F.when(F.col("l_quantity") > 25, "bulk").otherwise("small"))


@query("ag14_chi2_stat", CHI_SQL)
def chi2_stat(spark, sf):
    """Statistic and dof (exact twin); ``ag14_chi2`` adds the p-value."""
    return ST.chi2_stat(_chi_base(spark, sf), CHI_PAIRS)


# one and two degrees of freedom: the error function by its series, and an exponential
@query("ag14_chi2", f"""
SELECT *, p_value < 0.05 AS significant FROM (
  SELECT *, CASE dof WHEN 2 THEN exp(-chi2 / 2)
    WHEN 1 THEN 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60),
      lambda n: pow(-1, n) * pow(sqrt(chi2 / 2), 2 * n + 1) / (gamma(n + 1) * (2 * n + 1)))) END AS p_value FROM ({CHI_SQL}) x) y
""")
def chi2(spark, sf):
    return ST.chi2_independence(_chi_base(spark, sf), CHI_PAIRS)


def _jb_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, 'jarque_bera' AS test, n, jb AS statistic, exp(-jb / 2) AS p_value,
       exp(-jb / 2) > 0.05 AS is_normal
FROM (SELECT n, n / CAST(6 AS DOUBLE) * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / pow(m2, 2) - 3, 2) / 4) AS jb
      FROM (SELECT count({c}) AS n, avg(pow({c} - mu, 2)) AS m2, avg(pow({c} - mu, 3)) AS m3,
                   avg(pow({c} - mu, 4)) AS m4
            FROM {MISSING_SQL} t, (SELECT avg({c}) AS mu FROM {MISSING_SQL} t2) mm) s) j"""


@query("ag15_normality", union_all([_jb_sql(c) for c in NUM]))
def normality(spark, sf):
    return ST.normality_test(lineitem_with_missing(spark, sf), NUM)


@query("ag16_trend", """
SELECT l_quantity AS x, avg(l_extendedprice) AS y_mean, count(l_extendedprice) AS n
FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY l_quantity
""")
def trend(spark, sf):
    return ST.trend(load(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query("ag17_class_weights", f"""
SELECT is_returned, count(*) AS n,
       CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)) AS weight
FROM {LABELED_SQL} t WHERE is_returned IS NOT NULL GROUP BY is_returned
""")
def class_weights(spark, sf):
    return PR.class_weights(lineitem_labeled(spark, sf), "is_returned")


SMOOTH_SQL = """
WITH t AS (SELECT CAST(l_quantity AS DOUBLE) AS x, avg(l_extendedprice) AS y FROM lineitem
           WHERE l_quantity IS NOT NULL GROUP BY l_quantity),
m AS (SELECT count(*) AS m FROM t),
k AS (SELECT greatest(2, least(m, CAST(floor(0.3 * m + 1e-10) AS BIGINT))) AS k FROM m),
p AS (SELECT a.x AS xi, b.x AS xj, b.y AS yj, abs(b.x - a.x) AS d,
             row_number() OVER (PARTITION BY a.x ORDER BY abs(b.x - a.x), b.x) AS rn FROM t a, t b),
q AS (SELECT p.* FROM p, k WHERE rn <= k.k),
w AS (SELECT *, max(d) OVER (PARTITION BY xi) AS h FROM q),
ww AS (SELECT xi, xj, yj, CASE WHEN h <= 0 THEN 1.0 WHEN d < h THEN pow(1 - pow(d / h, 3), 3) ELSE 0.0 END AS w FROM w),
g AS (SELECT xi, sum(w) AS sw, sum(w * xj) AS sx, sum(w * yj) AS sy, sum(w * xj * xj) AS sxx, sum(w * xj * yj) AS sxy
      FROM ww GROUP BY xi)
SELECT t.x, t.y,
  CASE WHEN sw <= 0 THEN NULL
       WHEN abs(sw * sxx - sx * sx) > 1e-12 * greatest(1.0, sw * sxx)
         THEN (sy - ((sw * sxy - sx * sy) / (sw * sxx - sx * sx)) * sx) / sw
              + ((sw * sxy - sx * sy) / (sw * sxx - sx * sx)) * t.x
       ELSE sy / sw END AS smooth
FROM t JOIN g ON t.x = g.xi
"""


@query("ag16_smooth", SMOOTH_SQL)
def smooth(spark, sf):
    """AG-16: LOWESS (frac 0.3, no robustness iteration) of the quantity
    trend; the DuckDB twin enumerates all pairs, the Spark plan a rank band."""
    tr = ST.trend(load(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return ST.smooth(tr, "x", "y_mean", frac=0.3, it=0)


@query("ag16_smooth_grid", f"""
WITH f AS ({SMOOTH_SQL}), r AS (SELECT min(x) AS lo, (max(x) - min(x)) * 0.1 AS width FROM f),
c AS (SELECT f.*, floor((x - lo) / width) AS cell FROM f, r),
e AS (SELECT cell, min(x) AS xa, max(x) AS xb, arg_min(smooth, x) AS fa, arg_max(smooth, x) AS fb FROM c GROUP BY cell)
SELECT c.x, c.y, CASE WHEN xa = xb THEN fa ELSE fa + (fb - fa) * (c.x - xa) / (xb - xa) END AS smooth FROM c JOIN e ON c.cell = e.cell
""")
def smooth_grid(spark, sf):
    """AG-16 with fits at the ends of ten cells only: work linear in the points."""
    tr = ST.trend(load(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return ST.smooth(tr, "x", "y_mean", frac=0.3, delta=0.1)


@query("ag16_smooth_robust")
def smooth_robust(spark, sf):
    """AG-16 with 3 bisquare robustness iterations (statsmodels' default)."""
    tr = ST.trend(load(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return ST.smooth(tr, "x", "y_mean", frac=0.3, it=3)

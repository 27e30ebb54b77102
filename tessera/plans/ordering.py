"""Order-dependent queries (SL-*, SP-*, WN-*, SO-*) with DuckDB twins.

The registered queries use a small ``rows_per_bucket`` so that the bucketed
global-rank plan (the one used at scale) is what the oracle checks, not the
single-bucket shortcut."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import sample as SA
from tessera.plans.registry import load, query
from tessera.plans.sqlgen import mix64

SEED = 42


@query("sl01_top_k", """
SELECT * FROM orders WHERE o_totalprice IS NOT NULL ORDER BY o_totalprice DESC, o_orderkey LIMIT 10
""")
def top_k(spark, sf):
    return SA.top_k(load(spark, sf, "orders"), 10, "o_totalprice", "o_orderkey")


@query("sl03_head", "SELECT * FROM customer ORDER BY c_custkey LIMIT 100")
def head(spark, sf):
    return SA.head(load(spark, sf, "customer"), 100, "c_custkey")


@query("sp01_sample_n", f"""
SELECT * FROM orders ORDER BY {mix64('o_orderkey', SEED)}, o_orderkey LIMIT 500
""")
def sample_n(spark, sf):
    return SA.sample_n(load(spark, sf, "orders"), 500, "o_orderkey", SEED)


@query("sp02_stratified_split", f"""
SELECT o_orderkey, o_orderstatus,
  (row_number() OVER (PARTITION BY o_orderstatus ORDER BY h, o_orderkey) - 1)
    < ceil(count(*) OVER (PARTITION BY o_orderstatus) * 0.2) AS is_test
FROM (SELECT o_orderkey, o_orderstatus, {mix64('o_orderkey', SEED)} AS h FROM orders) t
""")
def stratified_split(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return SA.stratified_split(o, "o_orderstatus", "o_orderkey", 0.2, SEED)


@query("sp02_stratified_split_hash", f"""
SELECT o_orderkey, o_orderstatus, ({mix64('o_orderkey', SEED)} % 10000) < 2000 AS is_test FROM orders
""")
def stratified_split_hash(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return SA.stratified_split(o, "o_orderstatus", "o_orderkey", 0.2, SEED, exact=False)


@query("sp03_stratified_folds", f"""
SELECT o_orderkey, o_orderstatus,
  CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY h, o_orderkey) - 1) * 5 // count(*) OVER (PARTITION BY o_orderstatus) AS INTEGER) AS fold
FROM (SELECT o_orderkey, o_orderstatus, {mix64('o_orderkey', SEED)} AS h FROM orders) t
""")
def stratified_folds(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return SA.stratified_folds(o, "o_orderstatus", "o_orderkey", 5, SEED)


@query("sp04_grouped_split", f"""
WITH e AS (SELECT event_id, user_id, event_type FROM events),
g AS (SELECT user_id, {mix64('user_id', SEED)} AS h, count(*) AS c FROM e GROUP BY user_id),
b AS (SELECT user_id, c, sum(c) OVER (ORDER BY h, user_id) - c AS before FROM g),
t AS (SELECT CAST(ceil(count(*) * 0.2) AS BIGINT) AS t FROM e)
SELECT e.event_id, e.user_id, b.before + b.c <= t.t OR (b.before < t.t AND 2 * (t.t - b.before) > b.c) AS is_test
FROM e JOIN b ON e.user_id = b.user_id, t
""")
def grouped_split(spark, sf):
    """SP-2 with a grouped key: all events of a user fall on one side."""
    ev = load(spark, sf, "events").select("event_id", "user_id", "event_type")
    return SA.stratified_split(ev, "event_type", "event_id", 0.2, SEED, group="user_id").drop("event_type")


@query("wn02_assign_batches", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CAST(i // (n // 10) + 1 AS INTEGER) AS batch FROM r WHERE i < (n // 10) * 10
""")
def assign_batches(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey")
    return SA.assign_batches(o, 10, "o_orderkey", remainder="drop")


@query("wn01_rolling_mean", """
SELECT day, avg_value, n,
       avg(avg_value) OVER (ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS avg_value_ma
FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, avg(value) AS avg_value, count(*) AS n FROM events GROUP BY 1) d
""")
def rolling_mean(spark, sf):
    """Daily mean event value and its 3-day trailing mean (the window runs
    over the per-day table, not over raw events)."""
    ev = load(spark, sf, "events")
    d = ev.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.avg("value").alias("avg_value"), F.count(F.lit(1)).alias("n"))
    return SA.rolling_mean(d, ["avg_value"], "day", 3)


@query("so01_union_all", """
SELECT c_custkey AS key, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, 'customer' AS kind FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_nationkey, s_acctbal, 'supplier' FROM supplier
""")
def union(spark, sf):
    c = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"),
        F.col("c_acctbal").alias("acctbal"), F.lit("customer").alias("kind"))
    s = load(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"),
        F.col("s_acctbal").alias("acctbal"), F.lit("supplier").alias("kind"))
    return SA.union_all([c, s])

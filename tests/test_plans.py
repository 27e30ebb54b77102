"""Plan guards for the scale claims: operators that must not funnel rows
through one partition have no row-carrying ``SinglePartition`` exchange in
their plan (a ``Window`` without ``partitionBy`` would add one); the final
merge of a global aggregate (partial rows only) is allowed."""

from pyspark.sql import functions as F

from tessera.operators import metrics as MT
from tessera.operators import profile as PR
from tessera.operators import sample as SA
from tessera.operators import stats as ST


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows_through_one_partition(plan: str) -> bool:
    """True when a SinglePartition exchange carries rows.  The only allowed
    one sits on a partial global aggregate (one partial row per task)."""
    lines = plan.splitlines()
    for i, ln in enumerate(lines):
        if "Exchange SinglePartition" in ln:
            nxt = lines[i + 1] if i + 1 < len(lines) else ""
            if not ("HashAggregate(keys=[]" in nxt and "partial_" in nxt):
                return True
    return False


def _frame(spark):
    return spark.range(0, 20000, 1, 8).select(
        "id", (F.col("id") % 5).alias("label"), (F.col("id") % 97 / 97.0).alias("score"),
        (F.col("id") % 7).cast("string").alias("a"), (F.col("id") % 3).cast("string").alias("b"))


def test_bucketed_ranks_have_no_single_partition(spark):
    df = _frame(spark)
    for d in (SA.ordered_index(df, ["id"], rows_per_bucket=1000),
              SA.stratified_folds(df, "label", "id", 5),
              SA.assign_batches(df, 10, "id"),
              MT.roc_auc(df.withColumn("y", (F.col("label") == 0).cast("int")), "score", "y", rows_per_bucket=10),
              SA.string_rank(df.select(F.format_string("s%06d", "id").alias("s")), "s", rows_per_bucket=1000)):
        p = _plan(d)
        assert not _rows_through_one_partition(p), p[:3000]
        ranked = "fold" not in d.columns and "batch" not in d.columns
        assert ("Window" in p) == ranked  # folds and batches are comparisons with boundaries


def test_grouped_statistics_have_no_single_partition(spark):
    df = _frame(spark)
    for d in (PR.value_counts(df, "a"), ST.chi2_stat(df, [("a", "b")])):
        assert not _rows_through_one_partition(_plan(d))


def test_guard_detects_an_unpartitioned_window(spark):
    from pyspark.sql import Window
    d = _frame(spark).withColumn("r", F.row_number().over(Window.orderBy("id")))
    assert _rows_through_one_partition(_plan(d))


def test_row_scale_operators_have_no_single_partition_rows(spark):
    from tessera.functions import columns as C
    from tessera.operators import impute as IM
    from tessera.operators import quality as QC
    df = _frame(spark).withColumn("x", F.col("id") * 0.5)
    suite = {"column_expectations": {"a": [{"type": "expect_column_values_to_be_in_set",
                                            "kwargs": {"value_set": ["1", "2"]}}],
                                     "x": [{"type": "expect_column_values_to_be_between",
                                            "kwargs": {"min_value": 0, "max_value": 10}}]}}
    frames = [QC.run_suite(df, suite), PR.describe(df, ["x", "score"]), PR.correlation_matrix(df, ["x", "score"]),
              ST.anova_f(df, ["x"], "a"), ST.normality_test(df, ["x"]), PR.table_profile(df),
              IM.impute_group_median(df, "a", "x"), C.one_hot(df, "a"),
              MT.binary_metrics(df.withColumn("y", (F.col("label") == 0).cast("int"))
                                  .withColumn("p", (F.col("score") > 0.5).cast("int")), "y", "p", "score",
                                by=["a"], rows_per_bucket=100)]
    for d in frames:
        assert not _rows_through_one_partition(_plan(d)), _plan(d)[:3000]

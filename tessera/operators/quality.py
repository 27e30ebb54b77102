"""Data-quality suite (QC-1..11).

A suite is a plain dict shaped like the reference policy::

    {"table_expectations": [{"type": ..., "kwargs": {...}}, ...],
     "column_expectations": {"col": [{"type": ..., "kwargs": {...}}, ...]}}

``run_suite`` compiles every rule into aggregate expressions of one ``agg``
(one scan of the table however many rules there are) and unpivots the single
result row into one row per check.  Set rules also list their columns' smallest
distinct values: one narrow scan per such column (distinct, then top n).
Schema rules need no job at all.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import between, is_in

RESULT_FIELDS = [
    ("check_id", "int"), ("rule", "string"), ("column", "string"), ("success", "boolean"),
    ("observed", "double"), ("min_obs", "double"), ("max_obs", "double"),
    ("missing", "string"), ("unexpected", "string"), ("error", "string"),
]
UNIQUE_OBS_LIMIT = 10


def _q(c):
    return F.col(f"`{c}`")


@dataclass
class Compiled:
    """Aggregate expressions of one check plus the projection that turns the
    aggregated row into the check's result fields."""
    aggs: list[Column]
    fields: dict[str, Column]
    unique_obs_col: str | None = None


def _lit(v, t):
    return F.lit(v).cast(t)


def _base_fields(i: int, rule: str, column: str | None) -> dict[str, Column]:
    d = {k: _lit(None, t) for k, t in RESULT_FIELDS}
    d["check_id"] = _lit(i, "int")
    d["rule"] = _lit(rule, "string")
    d["column"] = _lit(column, "string")
    return d


# ------------------------------------------------------------ rule registry --

RULES: dict[str, Callable] = {}


def rule(*names: str):
    """QC-9: register a rule under its full and short names."""
    def deco(fn):
        for n in names:
            RULES[n] = fn
        return fn
    return deco


def resolve(name: str) -> Callable:
    if name in RULES:
        return RULES[name]
    raise KeyError(f"unknown quality rule {name!r}; known: {sorted(RULES)}")


@rule("expect_table_row_count_to_be_between", "row_count_between")
def _row_count(i, df, column, kw) -> Compiled:
    """QC-1."""
    lo, hi = kw.get("min_value", 0), kw.get("max_value")
    n = F.col(f"_a{i}_n")
    f = _base_fields(i, "expect_table_row_count_to_be_between", None)
    ok = n >= F.lit(lo)
    if hi is not None:
        ok = ok & (n <= F.lit(hi))
    f.update(success=ok, observed=n.cast("double"))
    return Compiled([F.count(F.lit(1)).alias(f"_a{i}_n")], f)


@rule("expect_table_columns_to_match_set", "columns_match_set")
def _match_set(i, df, column, kw) -> Compiled:
    """QC-2: set equality of column names (schema only, SO-2)."""
    from tessera.operators.sample import schema_diff
    diff = schema_diff(kw.get("column_set", []), df.columns)
    missing, unexpected = diff["missing"], diff["unexpected"]
    f = _base_fields(i, "expect_table_columns_to_match_set", None)
    f.update(success=F.lit(not missing and not unexpected),
             missing=_lit("|".join(missing), "string"),
             unexpected=_lit("|".join(unexpected), "string"))
    return Compiled([], f)


@rule("expect_column_values_to_not_be_null", "not_null")
def _not_null(i, df, column, kw) -> Compiled:
    """QC-3: fill rate over all rows >= mostly."""
    mostly = kw.get("mostly", 1.0)
    n, nn = F.col(f"_a{i}_n"), F.col(f"_a{i}_nulls")
    rate = F.when(n > 0, 1.0 - nn / n)
    f = _base_fields(i, "expect_column_values_to_not_be_null", column)
    f.update(success=F.coalesce(rate >= F.lit(mostly), F.lit(False)), observed=rate)
    return Compiled([F.count(F.lit(1)).alias(f"_a{i}_n"),
                     F.count_if(_values(df, column).isNull()).alias(f"_a{i}_nulls")], f)


def _values(df: DataFrame, column: str) -> Column:
    """The column with NaN as missing, as everywhere else in the library."""
    c = _q(column)
    if df.schema[column].dataType.typeName() in ("float", "double"):
        return F.when(~F.isnan(c), c)
    return c


def _empty_guard(i, f, nn):
    f["success"] = F.when(nn == 0, F.lit(False)).otherwise(f["success"])
    f["error"] = F.when(nn == 0, F.lit("column is entirely null"))
    return f


@rule("expect_column_values_to_be_between", "between")
def _between(i, df, column, kw) -> Compiled:
    """QC-4: share of non-null values inside [min, max]; min/max observed."""
    mostly = kw.get("mostly", 1.0)
    c = _values(df, column)
    nn, ok = F.col(f"_a{i}_nn"), F.col(f"_a{i}_ok")
    rate = F.when(nn > 0, ok / nn)
    f = _base_fields(i, "expect_column_values_to_be_between", column)
    f.update(success=F.coalesce(rate >= F.lit(mostly), F.lit(False)), observed=rate,
             min_obs=F.col(f"_a{i}_min").cast("double"), max_obs=F.col(f"_a{i}_max").cast("double"))
    f = _empty_guard(i, f, nn)
    return Compiled([F.count(c).alias(f"_a{i}_nn"),
                     F.count_if(c.isNotNull() & between(c, kw.get("min_value"), kw.get("max_value"))).alias(f"_a{i}_ok"),
                     F.min(c).alias(f"_a{i}_min"), F.max(c).alias(f"_a{i}_max")], f)


@rule("expect_column_values_to_be_in_set", "in_set")
def _in_set(i, df, column, kw) -> Compiled:
    """QC-5 (+QC-6: the smallest distinct values observed)."""
    mostly = kw.get("mostly", 1.0)
    c = _values(df, column)
    nn, ok = F.col(f"_a{i}_nn"), F.col(f"_a{i}_ok")
    rate = F.when(nn > 0, ok / nn)
    f = _base_fields(i, "expect_column_values_to_be_in_set", column)
    f.update(success=F.coalesce(rate >= F.lit(mostly), F.lit(False)), observed=rate)
    f = _empty_guard(i, f, nn)
    return Compiled([F.count(c).alias(f"_a{i}_nn"),
                     F.count_if(c.isNotNull() & is_in(c, kw.get("value_set", []))).alias(f"_a{i}_ok")],
                    f, unique_obs_col=column)


def _error(i, rule_name, column, msg) -> Compiled:
    f = _base_fields(i, rule_name, column)
    f.update(success=F.lit(False), error=_lit(msg, "string"))
    return Compiled([], f)


# ---------------------------------------------------------------- the suite --

def iter_checks(suite: dict):
    for exp in suite.get("table_expectations", []) or []:
        yield exp["type"], None, exp.get("kwargs", {}) or {}
    for col, exps in (suite.get("column_expectations", {}) or {}).items():
        for exp in exps:
            yield exp["type"], col, exp.get("kwargs", {}) or {}


def _unique_obs(df: DataFrame, cols: list[str], limit: int = UNIQUE_OBS_LIMIT) -> DataFrame | None:
    """Up to ``limit`` smallest distinct non-null values per column, joined by
    '|'.  Each column is distinct (partial aggregation) + top-n, so no task
    ever holds a whole column's distinct set."""
    if not cols:
        return None
    parts = [df.select(_values(df, c).alias("v")).where("v IS NOT NULL").distinct()
               .orderBy("v").limit(limit)
               .agg(F.array_join(F.transform(F.sort_array(F.collect_list("v")),
                                             lambda x: x.cast("string")), "|").alias("unique_obs"))
               .select(F.lit(c).alias("column"), "unique_obs")
             for c in sorted(set(cols))]
    return reduce(lambda a, b: a.unionByName(b), parts)


def run_suite(df: DataFrame, suite: dict, fail_on_error: bool = False,
              unique_limit: int = UNIQUE_OBS_LIMIT) -> DataFrame:
    """QC-8: one row per check with the fields of ``RESULT_FIELDS`` plus
    ``unique_obs``.  With ``fail_on_error`` the (bounded) result is collected
    and a ``RuntimeError`` raised when any check failed."""
    compiled: list[Compiled] = []
    for i, (name, col, kw) in enumerate(iter_checks(suite)):
        try:
            fn = resolve(name)
        except KeyError:
            compiled.append(_error(i, name, col, "rule not implemented"))
            continue
        if col is not None and col not in df.columns:
            compiled.append(_error(i, name, col, f"column {col} does not exist"))
            continue
        try:
            c = fn(i, df, col, kw)
            df.agg(*(c.aggs or [F.count(F.lit(1))]))  # analysis only: a rule that does not fit the column fails here
        except Exception as e:  # noqa: BLE001  a broken rule is a failed check, not a failed suite
            c = _error(i, name, col, f"rule failed: {str(e).splitlines()[0][:200]}")
        compiled.append(c)
    aggs = [a for c in compiled for a in c.aggs] or [F.count(F.lit(1)).alias("_dummy")]
    row = df.agg(*aggs)
    structs = [F.struct(*[c.fields[k].cast(t).alias(k) for k, t in RESULT_FIELDS]) for c in compiled]
    checks = row.select(F.inline(F.array(*structs)))
    u = _unique_obs(df, [c.unique_obs_col for c in compiled if c.unique_obs_col], unique_limit)
    if u is not None:
        set_rules = F.col("rule") == "expect_column_values_to_be_in_set"
        # result rows are bounded by the number of rules: broadcast is safe
        checks = checks.join(F.broadcast(u), on="column", how="left") \
                       .withColumn("unique_obs", F.when(set_rules, F.col("unique_obs")))
    else:
        checks = checks.withColumn("unique_obs", F.lit(None).cast("string"))
    checks = checks.select(*[k for k, _ in RESULT_FIELDS], "unique_obs")
    if fail_on_error:
        rows = checks.collect()
        failed = [r for r in rows if not r["success"]]
        if failed:
            raise RuntimeError(f"quality suite failed: {len(failed)}/{len(rows)} checks")
    return checks


def with_kwargs(checks: DataFrame, suite: dict) -> DataFrame:
    """The checks with each rule's parameters as JSON (one row per rule)."""
    rows = [(i, json.dumps(kw, sort_keys=True)) for i, (_, _, kw) in enumerate(iter_checks(suite))]
    kwargs = checks.sparkSession.createDataFrame(rows, "check_id int, kwargs string")
    return checks.join(F.broadcast(kwargs), "check_id", "left")


def quality_report(checks: DataFrame, path: str, mode: str = "overwrite", suite: dict | None = None) -> None:
    """QC-10: the checks as JSON lines ``{type, column, success, result fields}``
    and, with the ``suite``, the rules' ``kwargs``; ``type`` filled and booleans
    as booleans (the two reference report defects are not reproduced).  The
    checks table has one row per rule, so it is written as a single file."""
    out = with_kwargs(checks, suite) if suite is not None else checks
    out.withColumnRenamed("rule", "type").coalesce(1).write.mode(mode).json(path)


def suite_summary(checks: DataFrame) -> DataFrame:
    """``success, total, passed, failed`` from the checks table (tiny agg)."""
    return checks.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("success")).alias("passed"),
        F.count_if(~F.col("success")).alias("failed"),
    ).withColumn("success", F.col("failed") == 0)


# -------------------------------------------------------------- QC-11 rows --

def row_rules_from_suite(suite: dict, df: DataFrame) -> list[tuple[str, Column]]:
    """Row-level predicates for the column rules of a suite.  Range and set
    rules hold on null values (nullness is its own rule), as in the suite."""
    out = []
    for name, col, kw in iter_checks(suite):
        if col is None or col not in df.columns:
            continue
        c = _q(col)
        if name in ("expect_column_values_to_not_be_null", "not_null"):
            out.append((f"{col}:not_null", c.isNotNull()))
        elif name in ("expect_column_values_to_be_between", "between"):
            out.append((f"{col}:between", c.isNull() | between(c, kw.get("min_value"), kw.get("max_value"))))
        elif name in ("expect_column_values_to_be_in_set", "in_set"):
            out.append((f"{col}:in_set", c.isNull() | is_in(c, kw.get("value_set", []))))
    return out


def with_errors(df: DataFrame, rules: list[tuple[str, Column]], col: str = "_errors") -> DataFrame:
    """QC-11: array of the names of the failed row rules (empty when valid)."""
    return df.withColumn(col, F.array_compact(F.array(*[
        F.when(~F.coalesce(pred, F.lit(False)), F.lit(name)) for name, pred in rules])))


def split_valid(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """QC-11: (valid rows, quarantined rows with ``_errors``) — one narrow
    projection; :func:`route_valid` writes both sides from the same scan."""
    tagged = with_errors(df, rules)
    return (tagged.where(F.size("_errors") == 0).drop("_errors"),
            tagged.where(F.size("_errors") > 0))


def route_valid(df: DataFrame, rules: list[tuple[str, Column]], path: str, mode: str = "overwrite",
                errors: str = "_errors", verdict: str = "verdict") -> tuple[DataFrame, DataFrame]:
    """QC-11 as a sink: one scan of ``df`` and one write, partitioned into
    ``verdict=valid`` and ``verdict=quarantine``, with no shuffle; returns the two
    sides read back (the quarantined with ``errors``).  Reading a side lists and
    scans its own files only.  A side without rows is an empty table; ``df`` must
    not have columns named ``errors`` or ``verdict`` (in any case)."""
    taken = {c.lower() for c in df.columns} & {errors.lower(), verdict.lower()}
    if taken:
        raise ValueError(f"the table has columns named {sorted(taken)}; choose other names for errors and verdict")
    side = F.when(F.size(F.col(errors)) == 0, "valid").otherwise("quarantine")
    routed = with_errors(df, rules, errors).withColumn(verdict, side)
    routed.write.mode(mode).partitionBy(verdict).parquet(path)
    back = df.sparkSession.read.schema(routed.schema).parquet(path)

    def only(which: str) -> DataFrame:
        return back.where(F.col(verdict) == which).drop(verdict)
    return only("valid").drop(errors), only("quarantine")

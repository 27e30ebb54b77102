"""Column expressions and narrow projections (PF-*, FE-*).

Everything here is a built-in Spark expression: it stays inside whole-stage
codegen and adds no shuffle.  The null rules follow the reference's pandas
behaviour exactly (see the README section "Null rules"):

* comparisons against a missing value yield 0 for flags (N3),
* clipping keeps nulls (N4) — ``greatest`` would turn them into the bound,
* zero denominators follow ``zero_policy`` (N5) — ANSI division by 0 raises,
* unmapped / null categories encode to -1 (N6),
* a null category yields all-zero dummies while ``""`` is a value (N7).
"""

from __future__ import annotations

import logging
from functools import reduce
from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

log = logging.getLogger("tessera")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- PF: rows --

def label_from_map(col, mapping: Mapping, default=None) -> Column:
    """PF-1: map values to a label, anything else -> ``default`` (null)."""
    items = list(mapping.items())
    expr = F.when(_c(col) == F.lit(items[0][0]), F.lit(items[0][1]))
    for k, v in items[1:]:
        expr = expr.when(_c(col) == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default))


def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """PF-2: drop columns; absent names are ignored."""
    return df.drop(*[c for c in cols if c in df.columns])


def select_by_type(df: DataFrame, kind: str = "numeric") -> list[str]:
    """PF-3: names of numeric or string columns (schema only, no job)."""
    want = NumericType if kind == "numeric" else StringType
    return [f.name for f in df.schema.fields if isinstance(f.dataType, want)]


def select_features(df: DataFrame, keep: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """PF-4: keep configured ∩ present columns in config order.

    Returns the projected frame and the list of configured names that are
    missing (reported, not raised)."""
    present = [c for c in keep if c in df.columns]
    missing = [c for c in keep if c not in df.columns]
    if missing:
        log.warning("select_features: missing columns %s", missing)
    return df.select(*[F.col(f"`{c}`") for c in present]), missing


def conform(df: DataFrame, ordered_cols: Sequence[str], fill=0) -> DataFrame:
    """PF-5: reindex to a fixed column list and order.

    ``fill`` only replaces *absent columns*; nulls in present columns stay."""
    return df.select(*[
        F.col(f"`{c}`") if c in df.columns else F.lit(fill).alias(c)
        for c in ordered_cols])


def drop_nulls(df: DataFrame, cols: Sequence[str] | None = None,
               how: str = "any") -> DataFrame:
    """PF-6: complete-case filter."""
    return df.dropna(how=how, subset=list(cols) if cols else None)


def between(col, lo=None, hi=None) -> Column:
    """PF-7: inclusive on both ends; a missing bound is open."""
    c = _c(col)
    conds = []
    if lo is not None:
        conds.append(c >= F.lit(lo))
    if hi is not None:
        conds.append(c <= F.lit(hi))
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def is_in(col, values: Iterable) -> Column:
    """PF-8."""
    return _c(col).isin(list(values))


def any_null(cols: Sequence) -> Column:
    """PF-9: true when any of the columns is null."""
    return reduce(lambda a, b: a | b, [_c(c).isNull() for c in cols])


def decide(prob, threshold: float = 0.30, strict: bool = False,
           positive=1, negative=0) -> Column:
    """PF-10: triage class from a probability.  ``strict`` selects ``>``
    (the older behaviour) instead of ``>=``."""
    p = _c(prob)
    cond = p > F.lit(threshold) if strict else p >= F.lit(threshold)
    return F.when(cond, F.lit(positive)).otherwise(F.lit(negative))


def risk_factors(rules: Sequence[tuple[str, Column]],
                 default: str = "no risk factor") -> Column:
    """PF-11: array of the names of the rules a row matches, or
    ``[default]`` when none matches.  A null predicate does not match."""
    hits = F.array_compact(F.array(*[
        F.when(F.coalesce(pred, F.lit(False)), F.lit(name)) for name, pred in rules]))
    return F.when(F.size(hits) == 0, F.array(F.lit(default))).otherwise(hits)


def round_half_even(col, scale: int = 4) -> Column:
    """PF-12: pandas ``round`` is half-to-even."""
    return F.bround(_c(col), scale)


# ------------------------------------------------------------ FE: features --

def flag_expr(col, value) -> Column:
    """FE-1 expression: ``col > value`` as 0/1; a null compares false (N3)."""
    return F.coalesce((_c(col) > F.lit(value)).cast("int"), F.lit(0))


def binary_flags(df: DataFrame, specs: Sequence[Mapping]) -> DataFrame:
    """FE-1: ``[{column, value, new_column}]``; an absent source column is
    skipped with a warning."""
    out = {}
    for s in specs:
        if s["column"] not in df.columns:
            log.warning("binary_flag: column %r absent, flag %r skipped",
                        s["column"], s["new_column"])
            continue
        out[s["new_column"]] = flag_expr(F.col(f"`{s['column']}`"), s["value"])
    return df.withColumns(out) if out else df


def ratio_expr(num, den, zero_policy: str = "epsilon", epsilon: float = 0.001) -> Column:
    """FE-2/FE-3: ``num / den``.

    ``zero_policy="epsilon"`` replaces a zero denominator by ``epsilon``
    (feature pipeline); ``"null"`` yields null (EDA).  A null operand
    yields null in both."""
    n, d = _c(num), _c(den)
    if zero_policy == "epsilon":
        safe = F.when(d == 0, F.lit(epsilon)).otherwise(d)
    elif zero_policy == "null":
        safe = F.nullif(d, F.lit(0))
    else:
        raise ValueError(f"unknown zero_policy {zero_policy!r}")
    return n.cast("double") / safe.cast("double")


def ratios(df: DataFrame, specs: Sequence[Mapping], zero_policy: str = "epsilon") -> DataFrame:
    """FE-2: ``[{name, numerator, denominator}]``."""
    return df.withColumns({
        s["name"]: ratio_expr(F.col(f"`{s['numerator']}`"), F.col(f"`{s['denominator']}`"),
                              zero_policy)
        for s in specs})


def log1p_clip_expr(col) -> Column:
    """FE-4: ``ln(1 + max(x, 0))``; null stays null (N4)."""
    c = _c(col).cast("double")
    return F.log1p(F.when(c < 0, F.lit(0.0)).otherwise(c))


def log_features(df: DataFrame, cols: Sequence[str], prefix: str = "log_") -> DataFrame:
    """FE-4 on present columns, named ``log_<col>``."""
    return df.withColumns({f"{prefix}{c}": log1p_clip_expr(F.col(f"`{c}`"))
                           for c in cols if c in df.columns})


def interactions(df: DataFrame, specs: Sequence[Mapping]) -> DataFrame:
    """FE-5: ``[{name, columns: [a, b]}]`` -> product; specs with a column
    count other than two are ignored."""
    out = {s["name"]: F.col(f"`{s['columns'][0]}`") * F.col(f"`{s['columns'][1]}`")
           for s in specs if len(s["columns"]) == 2}
    return df.withColumns(out) if out else df


def ordinal_expr(col, mapping: Mapping, default: int = -1) -> Column:
    """FE-6: fixed mapping, unmapped or null -> ``default`` (N6)."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, _c(col)), F.lit(default)).cast("int")


def factorize(df: DataFrame, col: str, key: str, new_col: str | None = None,
              order: str = "first", broadcast_limit: int = 100_000) -> DataFrame:
    """FE-7: integer code per distinct value; null -> -1.

    ``order="first"`` numbers values by first appearance, where appearance
    order is the explicit ``key`` column (a distributed table has no row
    order).  ``"alpha"`` sorts values, ``"frequency"`` counts descending.

    Plan: one partial+final aggregate builds the dictionary (size = number of
    distinct values), which is ranked and joined back.  The dictionary is
    broadcast only when its row count is below ``broadcast_limit``; above it a
    shuffle join is used."""
    new_col = new_col or f"{col}_encoded"
    c = F.col(f"`{col}`")
    d = df.where(c.isNotNull()).groupBy(c.alias("_v")).agg(
        F.min(F.col(f"`{key}`")).alias("_first"), F.count(F.lit(1)).alias("_n"))
    from tessera.operators.sample import ordered_index, range_rank
    n_distinct = d.count()
    if order == "first":
        # numeric first-appearance key: exact distributed rank of the dictionary
        d = ordered_index(d, ["_first", "_v"], name="_code", n_rows=n_distinct).select("_v", "_code")
    elif order == "frequency":
        # ranked by count and value together: values of one count spread over many tasks
        d = range_rank(d.withColumn("_negn", -F.col("_n")), ["_negn", "_v"], "_code", n_rows=n_distinct).select("_v", "_code")
    elif order == "alpha":
        d = range_rank(d, ["_v"], "_code", n_rows=n_distinct).select("_v", "_code")
    else:
        raise ValueError(order)
    side = F.broadcast(d) if n_distinct <= broadcast_limit else d
    out = df.join(side, c.eqNullSafe(F.col("_v")), "left")
    return out.withColumn(new_col, F.coalesce(F.col("_code"), F.lit(-1)).cast("int")) \
              .drop("_v", "_code")


def distinct_values(df: DataFrame, col: str, max_values: int = 1000) -> list:
    """Sorted distinct non-null values of a column, refusing beyond
    ``max_values`` (a cardinality cap for one-hot / pivot discovery).  Only
    the distinct set reaches the driver, never rows."""
    c = F.col(f"`{col}`")
    vals = (df.where(c.isNotNull()).select(c.alias("v")).distinct()
              .orderBy("v").limit(max_values + 1).collect())
    if len(vals) > max_values:
        raise ValueError(f"{col}: more than {max_values} distinct values")
    return [r["v"] for r in vals]


def one_hot(df: DataFrame, col: str, prefix: str = "cat", values: Sequence | None = None,
            drop_first: bool = False, max_values: int = 1000) -> DataFrame:
    """FE-8: one 0/1 column ``<prefix>_<col>_<value>`` per value.

    ``values`` fixes the categories (train/serve parity); when omitted they
    are discovered (sorted, capped).  ``""`` is a category; a null row gets
    all zeros (N7).  ``drop_first`` drops the first category."""
    if values is None:
        values = distinct_values(df, col, max_values)
    values = list(values)[1:] if drop_first else list(values)
    c = F.col(f"`{col}`")
    return df.withColumns({
        f"{prefix}_{col}_{v}": F.coalesce((c == F.lit(v)).cast("int"), F.lit(0))
        for v in values})


def cut_expr(col, cuts: Sequence[float], include_lowest: bool = True) -> Column:
    """FE-10 ordinal: right-closed bins ``(c[i], c[i+1]]`` numbered from 0;
    the first bin also holds ``c[0]`` when ``include_lowest``; values outside
    the edges and nulls -> null.  (Spark's ``Bucketizer`` is left-closed, so
    it is not used.)"""
    c = _c(col)
    first_ok = (c >= F.lit(cuts[0])) if include_lowest else (c > F.lit(cuts[0]))
    expr = F.when(first_ok & (c <= F.lit(cuts[1])), F.lit(0))
    for i in range(1, len(cuts) - 1):
        expr = expr.when((c > F.lit(cuts[i])) & (c <= F.lit(cuts[i + 1])), F.lit(i))
    return expr.cast("int")


def cut_label_expr(col, cuts: Sequence[float], labels: Sequence[str],
                   include_lowest: bool = True) -> Column:
    """FE-10 label: the label of :func:`cut_expr`'s bin, else null."""
    idx = cut_expr(col, cuts, include_lowest)
    arr = F.array(*[F.lit(x) for x in labels])
    return F.when(idx.isNotNull(), F.element_at(arr, idx + 1))


def cut(df: DataFrame, col: str, cuts: Sequence[float], labels: Sequence[str] | None = None,
        new_col: str | None = None, include_lowest: bool = True) -> DataFrame:
    """FE-10: adds ``<new_col>`` (label) and ``<new_col>_ord`` (bin ordinal)."""
    new_col = new_col or f"{col}_bin"
    labels = labels or [f"({cuts[i]}, {cuts[i+1]}]" for i in range(len(cuts) - 1)]
    c = F.col(f"`{col}`")
    return df.withColumns({new_col: cut_label_expr(c, cuts, labels, include_lowest),
                           f"{new_col}_ord": cut_expr(c, cuts, include_lowest)})


def quantile_edges(df: DataFrame, cols: Sequence[str], q: int,
                   approx: bool = False, accuracy: int = 100_000) -> dict[str, list[float]]:
    """FE-11 edges: quantiles ``0, 1/q, ..., 1`` of every column in ONE
    aggregate (linear interpolation, exact by default), duplicates merged.
    Only ``len(cols) * (q+1)`` numbers reach the driver."""
    probs = [i / q for i in range(q + 1)]
    if approx:
        row = df.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), probs, accuracy).alias(c)
                       for c in cols]).first()
        found = {c: row[c] for c in cols}
    else:
        from tessera.operators.quantiles import exact_quantiles
        found = exact_quantiles(df, cols, probs)
    out = {}
    for c in cols:
        edges = [e for e in (found[c] or []) if e is not None]
        dedup = sorted(set(edges))
        out[c] = dedup
    return out


def qcut(df: DataFrame, cols: Sequence[str], q: int = 4, suffix: str = "_bin",
         approx: bool = False) -> DataFrame:
    """FE-11: quantile bins for several columns with one edge aggregate.

    Adds ``<col><suffix>`` = bin ordinal (0-based, right-closed, lowest
    included) plus ``<col><suffix>_lo`` / ``_hi`` edges.  Nulls stay null."""
    edges = quantile_edges(df, cols, q, approx)
    out = {}
    for c in cols:
        e = edges[c]
        cc = F.col(f"`{c}`")
        if len(e) < 2:
            out[f"{c}{suffix}"] = F.when(cc.isNotNull(), F.lit(0)).cast("int")
            lo_arr = hi_arr = F.array(F.lit(e[0] if e else None).cast("double"))
        else:
            out[f"{c}{suffix}"] = cut_expr(cc, e, True)
            lo_arr = F.array(*[F.lit(float(x)) for x in e[:-1]])
            hi_arr = F.array(*[F.lit(float(x)) for x in e[1:]])
        idx = out[f"{c}{suffix}"]
        out[f"{c}{suffix}_lo"] = F.when(idx.isNotNull(), F.element_at(lo_arr, idx + 1))
        out[f"{c}{suffix}_hi"] = F.when(idx.isNotNull(), F.element_at(hi_arr, idx + 1))
    return df.withColumns(out)

"""Feature pipeline (FE-13) and its scoring twin (FE-14).

The whole pipeline — flags, ratios, logs, interactions, encodings, label and
selection — is a chain of ``DataFrame.transform`` steps made of narrow
projections; Catalyst collapses them into one Project inside one
whole-stage-codegen span.  Training and scoring use the SAME code path: the
only difference is that scoring receives the one-hot categories learned at
training time (``fitted``) instead of discovering them, which removes the
train/serve skew of the reference.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as C


def fit_categories(df: DataFrame, config: Mapping) -> dict[str, list]:
    """Discover the one-hot categories of the encoding columns (distinct
    values, capped) — the only state of the pipeline."""
    enc = config.get("categorical_encoding", {})
    return {c: C.distinct_values(df, c, enc.get("max_values", 1000))
            for c in enc.get("columns", []) if c in df.columns}


def feature_pipeline(df: DataFrame, config: Mapping, fitted: Mapping | None = None) -> DataFrame:
    """FE-13: fixed order flags -> ratios -> logs -> interactions ->
    encoding -> label -> selection.

    ``config`` keys (all optional): ``binary_flags`` [{column, value,
    new_column}], ``ratio_features`` [{name, numerator, denominator}],
    ``zero_policy``, ``log_transform`` {columns}, ``polynomial_features``
    [{name, columns}], ``categorical_encoding`` {columns, one_hot_prefix,
    mappings {col: {value: code}}, drop_first, key}, ``target`` {column,
    mapping, name}, ``features_to_keep`` [...]."""
    fitted = dict(fitted) if fitted is not None else fit_categories(df, config)
    out = df
    out = C.binary_flags(out, config.get("binary_flags", []))
    out = C.ratios(out, config.get("ratio_features", []), config.get("zero_policy", "epsilon"))
    out = C.log_features(out, config.get("log_transform", {}).get("columns", []))
    out = C.interactions(out, config.get("polynomial_features", []))
    enc = config.get("categorical_encoding", {})
    mappings = enc.get("mappings", {})
    prefix = enc.get("one_hot_prefix", "cat")
    for col in enc.get("columns", []):
        if col not in out.columns:
            continue
        if col in mappings:
            out = out.withColumn(f"{col}_encoded", C.ordinal_expr(F.col(f"`{col}`"), mappings[col]))
        elif enc.get("key"):
            out = C.factorize(out, col, enc["key"])
        out = C.one_hot(out, col, prefix, values=fitted.get(col, []), drop_first=enc.get("drop_first", False))
    tgt = config.get("target")
    if tgt:
        out = out.withColumn(tgt.get("name", "target_numeric"),
                             C.label_from_map(F.col(f"`{tgt['column']}`"), tgt.get("mapping", {"Yes": 1, "No": 0})))
    keep = config.get("features_to_keep")
    if keep:
        out, _ = C.select_features(out, keep)
    return out


def scoring_features(df: DataFrame, config: Mapping, fitted: Mapping, ordered_cols=None,
                     fill=0) -> DataFrame:
    """FE-14: the same pipeline on raw records with the training categories;
    a flag whose source column is absent is set to 0, and the result is
    conformed to the training column order (absent columns -> ``fill``)."""
    cfg = dict(config)
    cfg.pop("target", None)
    out = feature_pipeline(df, {k: v for k, v in cfg.items() if k != "features_to_keep"}, fitted)
    for s in config.get("binary_flags", []):
        if s["new_column"] not in out.columns:
            out = out.withColumn(s["new_column"], F.lit(0))
    cols = ordered_cols or [c for c in config.get("features_to_keep", []) if c != config.get("target", {}).get("name", "target_numeric")]
    return C.conform(out, cols, fill) if cols else out

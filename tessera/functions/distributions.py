"""Tail probabilities for the test statistics (no scipy in the image).

These run on result tables whose size is the number of tested columns, as
vectorised pandas UDFs; the statistics themselves are computed by Spark
aggregates.  Tails are integrated numerically on a logarithmic scale, where the
densities are smooth with one peak.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Ship this module's code with the UDFs (pickle by value): Python workers
# then need only numpy / pandas, not this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(40)


def _mass(log_f, start: float, step: float, top: float) -> float:
    """Integral of ``exp(log_f - top)`` from ``start`` outward, in panels of
    ``step`` (negative: to the left), until a panel adds nothing."""
    total = 0.0
    for k in range(100_000):
        x = start + step * (k + (1 + _NODES) / 2)
        with np.errstate(over="ignore"):
            part = abs(step) / 2 * float(np.dot(_WEIGHTS, np.exp(log_f(x) - top)))
        total += part
        if part <= 1e-17 * total:
            break
    return total


def _upper_tail(log_f, slope, mode: float, width: float, at: float) -> float:
    """Share of the mass of a unimodal density above ``at``, by Gauss-Legendre
    panels outward from the mode and from ``at``; the density needs no
    normalisation.  The side of ``at`` away from the mode is integrated, scaled
    by its largest value, so small tails keep their relative accuracy."""
    top = float(log_f(np.array(mode)))
    whole = _mass(log_f, mode, 2 * width, top) + _mass(log_f, mode, -2 * width, top)
    here = float(log_f(np.array(at)))
    step = min(2 * width, 20 / max(abs(slope(at)), 1e-12))
    side = math.exp(here - top) * _mass(log_f, at, step if at >= mode else -step, here) / whole
    return side if at >= mode else 1.0 - side


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F > f) for the F(d1, d2) distribution, from the density of the log odds
    of its beta variable."""
    if f is None or d1 is None or d2 is None or any(map(math.isnan, (f, d1, d2))):
        return float("nan")
    if d1 <= 0 or d2 <= 0:
        return float("nan")
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    a, b = d1 / 2.0, d2 / 2.0
    return _upper_tail(lambda u: a * u - (a + b) * np.logaddexp(0.0, u),
                       lambda u: a - (a + b) / (1.0 + math.exp(-u) if u > -700 else math.inf),
                       math.log(a / b), math.sqrt((a + b) / (a * b)), math.log(d1 * f / d2))


def chi2_sf(x: float, dof: float) -> float:
    """P(X > x) for the chi-square distribution with ``dof`` degrees, from the
    density of its logarithm."""
    if x is None or dof is None or math.isnan(x) or math.isnan(dof) or dof <= 0:
        return float("nan")
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    a = dof / 2.0
    return _upper_tail(lambda u: a * u - np.exp(u), lambda u: a - math.exp(min(u, 700.0)),
                       math.log(a), 1.0 / math.sqrt(a), math.log(x / 2.0))


def _vec(fn, *cols: pd.Series) -> pd.Series:
    out = np.empty(len(cols[0]), dtype="float64")
    for i, args in enumerate(zip(*cols)):
        try:
            out[i] = fn(*[float("nan") if v is None or pd.isna(v) else float(v) for v in args])
        except (ValueError, OverflowError, ZeroDivisionError):
            out[i] = float("nan")
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def f_sf_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _vec(f_sf, f, d1, d2)


@F.pandas_udf(DoubleType())
def chi2_sf_udf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _vec(chi2_sf, x, dof)

"""Correlation, ranks and significance."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Executors need not have this package installed: its one UDF travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def pearson(x: Column, y: Column) -> Column:
    """Correlation over complete pairs; null for fewer than two pairs or no spread."""
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    spread = F.stddev_samp(px) * F.stddev_samp(py)
    r = F.try_divide(F.covar_samp(px, py), spread)
    # greatest/least would replace a null by the bound
    return F.when(r > 1.0, 1.0).when(r < -1.0, -1.0).otherwise(r)


def average_rank(partition: list[str], value: str) -> Column:
    """Ascending rank; equal values share the mean of their positions.

    The default ordered frame ends at the last peer, so its count is the highest
    position of a tie group and ``rank`` is the lowest.
    """
    w: WindowSpec = Window.partitionBy(*partition).orderBy(value)
    return (F.rank().over(w) + F.count(F.lit(1)).over(w)) / 2.0


def effective_n(n: Column, rho1: Column) -> Column:
    """Sample size of an autocorrelated series, n·(1−ρ₁)/(1+ρ₁)."""
    return F.try_divide(n * (1 - rho1), 1 + rho1)


def _continued_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Modified Lentz evaluation of the incomplete-beta continued fraction."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = np.ones_like(x)
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            out = out * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return out


def _incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) for 0 < x < 1."""
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    log_front = lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)
    front = np.exp(log_front)
    direct = x < (a + 1.0) / (a + b + 2.0)
    p, q = np.where(direct, a, b), np.where(direct, b, a)
    tail = front * _continued_fraction(p, q, np.where(direct, x, 1.0 - x)) / p
    return np.where(direct, tail, 1.0 - tail)


def two_sided_p(r: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| ≥ |t|) of a correlation r with df degrees of freedom.

    Evaluated as I_{1−r²}(df/2, ½), which keeps its precision for tiny results.
    """
    r, df = np.asarray(r, float), np.asarray(df, float)
    out = np.full(r.shape, np.nan)
    known = np.isfinite(r) & np.isfinite(df) & (df > 0)
    rest = (1.0 - r) * (1.0 + r)
    out[known & (rest <= 0)] = 0.0
    out[known & (rest >= 1)] = 1.0
    inner = known & (rest > 0) & (rest < 1)
    if inner.any():
        half = df[inner] / 2.0
        out[inner] = _incomplete_beta(half, np.full_like(half, 0.5), rest[inner])
    return out


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value; called once per series, after all aggregation."""
    p = pd.Series(two_sided_p(r.to_numpy(float), df.to_numpy(float)))
    return p.astype("object").where(p.notna(), None)

"""Distribution functions of the normal, t and F laws, in numpy, and as columns."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def beta_share(x: np.ndarray, a, b, steps: int = 300) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction; ``a`` and ``b`` are numbers or arrays."""
    x, a, b = np.clip(np.asarray(x, float), 0, 1), np.asarray(a, float), np.asarray(b, float)
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c = np.ones_like(y)
    d = 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps):
        for step in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    log_front = _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b)
    with np.errstate(divide="ignore"):
        front = np.exp(log_front + p * np.log(np.maximum(y, tiny)) + q * np.log1p(-np.minimum(y, 1 - 1e-16))) / p
    share = np.where(y <= 0, 0.0, front * h)
    return np.where(swap, 1 - share, share)


def f_cdf(x, df1, df2) -> np.ndarray:
    x, df1, df2 = np.maximum(np.asarray(x, float), 0), np.asarray(df1, float), np.asarray(df2, float)
    return beta_share(df1 * x / (df1 * x + df2), df1 / 2, df2 / 2)


def t_cdf(x, df: float) -> np.ndarray:
    x = np.asarray(x, float)
    tail = beta_share(df / (df + x * x), df / 2, 0.5) / 2
    return np.where(x >= 0, 1 - tail, tail)


def t_quantile(p: float, df: float) -> float:
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if float(t_cdf(mid, df)) < p else (low, mid)
    return (low + high) / 2


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def f_cdf_column(col: Column, df1: Column | float, df2: Column | float) -> Column:
    """The F law's share below ``col``; null where ``col`` is, or where a number of degrees of freedom isn't above 0."""

    @F.pandas_udf("double")
    def share(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        fine = x.notna() & (a > 0) & (b > 0)
        held = f_cdf(x.where(fine, 0.0), a.where(fine, 1.0), b.where(fine, 1.0))
        return pd.Series(held, index=x.index).where(fine)

    column = lambda v: v.cast("double") if isinstance(v, Column) else F.lit(float(v))
    return share(col, column(df1), column(df2))


def t_quantile_column(p: float, df: Column) -> Column:
    """The t law's quantile at ``p`` for each number of degrees of freedom; null where that isn't above 0."""

    @F.pandas_udf("double")
    def quantile(n: pd.Series) -> pd.Series:
        known = {v: t_quantile(p, float(v)) for v in n.dropna().unique() if v > 0}
        return n.map(known).astype("float64")

    return quantile(df.cast("double"))


def normal_quantile_column(col: Column) -> Column:
    """The normal law's quantile; null outside (0, 1)."""

    @F.pandas_udf("double")
    def quantile(x: pd.Series) -> pd.Series:
        inverse = NormalDist().inv_cdf
        return x.map(lambda p: inverse(p) if p is not None and 0 < p < 1 else None).astype("float64")

    return quantile(col)

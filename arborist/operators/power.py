"""Exact t tests for samples of any size, and the power of paired comparisons.

Student's t follows from the regularised incomplete beta function, by its continued fraction; the power of a
two-sided test from the non-central t, whose square is a Poisson mixture of such functions. Both are
array code over a batch of comparisons (one row each), used as columns.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .statistics import effect_label, required_pairs

# Lanczos' coefficients for g = 7.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
TINY = 1e-300


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers."""
    x = np.asarray(x, np.float64) - 1
    total = np.full_like(x, LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total += c / (x + i)
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * np.log(t) - t + np.log(total)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by the modified method of Lentz."""
    safe = lambda v: np.where(np.abs(v) < TINY, TINY, v)
    c = np.ones_like(x)
    d = 1 / safe(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 20_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / safe(1 + even * d), safe(1 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / safe(1 + odd * d), safe(1 + odd / c)
        h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """I_x(a, b) for positive a and b and x from 0 to 1, element by element."""
    a, b, x = (np.array(v, np.float64) for v in np.broadcast_arrays(a, b, x))
    out = np.where(x >= 1, 1.0, 0.0)
    mid = (x > 0) & (x < 1)
    if mid.any():
        a, b, x = a[mid], b[mid], x[mid]
        swap = x > (a + 1) / (a + b + 2)
        p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
        front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / p
        part = front * _fraction(p, q, y)
        out[mid] = np.where(swap, 1 - part, part)
    return out


def two_sided_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The probability of |T| >= |t| under Student's t; nan without degrees of freedom."""
    t, df = (np.array(v, np.float64) for v in np.broadcast_arrays(t, df))
    out = np.full(t.shape, np.nan)
    good = np.isfinite(t) & (df > 0)
    out[good] = incomplete_beta(df[good] / 2, 0.5, df[good] / (df[good] + t[good] * t[good]))
    out[np.isinf(t) & (df > 0)] = 0.0
    return out


def critical_t(alpha: float, df: np.ndarray) -> np.ndarray:
    """The t that |T| passes with probability alpha, by bisection."""
    df = np.asarray(df, np.float64)
    low, high = np.zeros_like(df), np.full_like(df, 1.0)
    while (more := two_sided_p(high, df) > alpha).any():
        high = np.where(more, 2 * high, high)
    for _ in range(200):
        middle = (low + high) / 2
        over = two_sided_p(middle, df) > alpha
        low, high = np.where(over, middle, low), np.where(over, high, middle)
        if np.all(high - low <= 1e-14 * high):
            break
    return (low + high) / 2


TERMS = 1 << 20


def power(d_z: np.ndarray, n: np.ndarray, alpha: float = 0.05) -> np.ndarray:
    """Of two-sided paired t tests over n pairs with an effect of d_z standard deviations; nan under two pairs, 1 beyond d_z^2 n = 10^8.

    The Poisson weights that count (12 deviations and 60 around their mean) are laid out for all tests
    side by side, about TERMS at a time.
    """
    d_z, n = (np.array(v, np.float64) for v in np.broadcast_arrays(d_z, n))
    out = np.full(d_z.shape, np.nan)
    half = d_z * d_z * n / 2
    good = (n >= 2) & np.isfinite(half)
    out[good & (half > 5e7)] = 1.0
    rows = np.flatnonzero(good & (half <= 5e7))
    if not len(rows):
        return out
    dfs, which = np.unique(n[rows] - 1, return_inverse=True)
    t = critical_t(alpha, dfs)[which]
    x = t * t / (t * t + n[rows] - 1)
    reach = 12 * np.sqrt(half[rows]) + 60
    first = np.maximum(0, np.floor(half[rows] - reach)).astype(np.int64)
    size = np.ceil(half[rows] + reach).astype(np.int64) - first
    part = (np.cumsum(size) - 1) // TERMS
    for p in range(int(part[-1]) + 1):
        own = np.flatnonzero(part == p)
        if not len(own):
            continue
        row = np.repeat(own, size[own])
        j = np.arange(len(row)) - np.repeat(np.cumsum(size[own]) - size[own], size[own]) + first[row]
        mean = half[rows][row]
        log_weight = -mean + np.where(j > 0, j * np.log(np.maximum(mean, TINY)), 0.0) - log_gamma(j + 1.0)
        below = np.exp(log_weight) * incomplete_beta(j + 0.5, (n[rows][row] - 1) / 2, x[row])
        out[rows[own]] = np.clip(1 - np.bincount(row, below, len(rows))[own], 0, 1)
    return out


def p_value(t: Column, df: Column) -> Column:
    """two_sided_p as a column."""

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(two_sided_p(t.to_numpy(np.float64, na_value=np.nan), df.to_numpy(np.float64, na_value=np.nan)))

    return p(t.cast("double"), df.cast("double"))


def achieved_power(d_z: Column, n: Column, alpha: float = 0.05) -> Column:
    """power as a column."""

    @F.pandas_udf("double")
    def of(d: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(power(d.to_numpy(np.float64, na_value=np.nan), n.to_numpy(np.float64, na_value=np.nan), alpha))

    return of(d_z.cast("double"), n.cast("double"))


def paired_t_exact(pairs: DataFrame, by: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    """(by..., n, mean_diff, t, p, d, effect, d_z, required_n): exact paired t tests of (key, a, b), one for each group.

    p comes from Student's t with n - 1 degrees of freedom. Fewer than two pairs have no t and no p; equal
    differences have t 0 and p 1 where they are zero, and no t otherwise. Means and deviations
    are partial aggregates, so that a hot group costs no more than any other.
    """
    diff = F.col("a") - F.col("b")
    g = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg(diff).alias("m"), F.stddev_samp(diff).alias("sd"), F.stddev_samp("a").alias("sa"), F.stddev_samp("b").alias("sb"))
    n = F.col("n").cast("double")
    t = F.when(F.col("n") < 2, None).when(F.col("sd") > 0, F.col("m") / (F.col("sd") / F.sqrt(n))).when(F.col("m") == 0, 0.0)
    pooled = F.sqrt((F.col("sa") * F.col("sa") + F.col("sb") * F.col("sb")) / 2.0)
    g = g.withColumns({"t": t, "d": F.when(pooled > 0, F.abs("m") / pooled).otherwise(0.0), "d_z": F.when(F.col("sd") > 0, F.col("m") / F.col("sd")).otherwise(0.0)})
    g = g.withColumn("p", F.nanvl(p_value(F.col("t"), F.col("n") - 1), F.lit(None).cast("double")))
    rounded = lambda c: F.round(c, digits).alias(c)
    return g.select(*by, "n", F.round("m", digits).alias("mean_diff"), rounded("t"), rounded("p"), rounded("d"), effect_label(F.col("d")).alias("effect"), rounded("d_z"), required_pairs(F.col("d_z")).cast("long").alias("required_n"))


def with_power(tests: DataFrame, alpha: float = 0.05, digits: int = 6) -> DataFrame:
    """Adds power, achieved by each test's (n, d_z); null under two pairs."""
    return tests.withColumn("power", F.round(F.nanvl(achieved_power(F.col("d_z"), F.col("n"), alpha), F.lit(None).cast("double")), digits))

"""Statistics: robust scale, Fisher means, and p-values from the incomplete beta function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from .selection import joined_keys, in_ranges, with_ranks, with_suffix_minimum

MAD_SCALE = 1.4826
TINY = 2.2250738585072014e-308
#: The step of doubles at 1: scales up to it count as zero.
STEP = 2.220446049250313e-16
CLIP = 0.999999


def with_robust_z(df: DataFrame, x: str, by: list[str], out: str, zero_scale: str = "zero", eps: float = STEP) -> DataFrame:
    """df with (x - median) / (1.4826 MAD) within groups in column out; null and NaN are left out of both medians.

    Where the scale is eps at most: all 0, missing values too ("zero", as for whole sessions), or divided by eps ("clamp", as for raw recordings).
    """
    w = Window.partitionBy(*by)
    real = F.when(~F.isnan(x), F.col(x)) if dict(df.dtypes)[x] in ("float", "double") else F.col(x)
    df = df.withColumn("_x", real).withColumn("_mid", F.median("_x").over(w)).withColumn("_dev", F.abs(F.col("_x") - F.col("_mid")))
    df = df.withColumn("_scale", MAD_SCALE * F.median("_dev").over(w))
    far = F.col("_x") - F.col("_mid")
    z = far / F.greatest(F.col("_scale"), F.lit(eps)) if zero_scale == "clamp" else F.when(F.col("_scale") > eps, far / F.col("_scale")).otherwise(F.lit(0.0))
    return df.withColumn(out, z).drop("_x", "_mid", "_dev", "_scale")


def log_floor(x: Column) -> Column:
    """log10, of the smallest normal number below it; missing stays missing."""
    return F.when(x.isNotNull(), F.log10(F.greatest(x, F.lit(TINY))))


def clipped(r: Column) -> Column:
    return F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), r))


def fisher(r: Column) -> Column:
    """atanh of a clipped correlation by one log1p, as the C library has it: tanh leads back to r itself where two logs would miss it by a step."""
    c = clipped(r)
    x = F.abs(c)
    twice = x + x
    return F.signum(c) * 0.5 * F.log1p(F.when(x < 0.5, twice + twice * x / (1 - x)).otherwise(twice / (1 - x)))


def fisher_mean(r: Column, weight: Column | None = None) -> Column:
    """Mean of correlations on the Fisher scale."""
    z = fisher(r)
    return F.tanh(F.avg(z)) if weight is None else F.tanh(F.sum(weight * z) / F.sum(F.when(r.isNotNull(), weight)))


def floored_std(x: Column, floor: float) -> Column:
    """Population deviation, 1 where it is below the floor."""
    s = F.stddev_pop(x)
    return F.when(s < floor, F.lit(1.0)).otherwise(s)


def benjamini_hochberg(df: DataFrame, p: str, out: str, by: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """q-values of Benjamini and Hochberg, within groups. One missing p makes all q of its group missing.

    Ranks and the reversed cumulative minimum are scans over ranges of p, so one list of any length is the work of many tasks; equal
    p-values are told apart by their rows' hashes.
    """
    keys = by or []
    rows = in_ranges(df.withColumn("_h", F.xxhash64(*df.columns)), [*map(F.col, keys), F.col(p), F.col("_h")], partitions)
    whole = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(F.col(p).isNotNull() & ~F.isnan(p)).alias("_ok"))
    ranked = with_ranks(joined_keys(rows, whole, keys), keys, "_rank")
    q = with_suffix_minimum(ranked, keys, F.col(p) * F.col("_n") / F.col("_rank"), "_q")
    return q.withColumn(out, F.when(F.col("_ok"), F.least("_q", F.lit(1.0)))).select(*df.columns, out)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's evaluation of the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_survival(t: float, df: float) -> float:
    """P(T > t)."""
    if math.isnan(t) or math.isnan(df) or df <= 0:
        return math.nan
    half = 0.5 * beta_cdf(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0
    return half if t > 0 else 1 - half


def t_quantile(q: float, df: float) -> float:
    """The t with P(T <= t) = q, by bisection."""
    if not (0 < q < 1) or not df > 0:
        return math.nan
    low, high = -1.0, 1.0
    while 1 - t_survival(low, df) > q:
        low *= 2
    while 1 - t_survival(high, df) < q:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_survival(mid, df) < q else (low, mid)
    return (low + high) / 2


def binomial_greater(k: float, n: float, p: float) -> float:
    """P(X >= k) of n trials."""
    if any(map(math.isnan, (k, n, p))):
        return math.nan
    return 1.0 if k <= 0 else 0.0 if k > n else beta_cdf(k, n - k + 1, p)


def _vector(f):
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([f(*map(float, x)) if not any(pd.isna(v) for v in x) else None for x in zip(*cols, strict=True)], dtype="float64")

    return run


@F.pandas_udf(DoubleType())
def t_greater(t: pd.Series, df: pd.Series) -> pd.Series:
    return _vector(t_survival)(t, df)


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return _vector(lambda a, b: 2 * t_survival(abs(a), b))(t, df)


@F.pandas_udf(DoubleType())
def t_ppf(q: pd.Series, df: pd.Series) -> pd.Series:
    return _vector(t_quantile)(q, df)


def paired_t_p(mean: Column, sd: Column, n: Column) -> Column:
    """Two-sided p-value of a mean of differences."""
    return t_two_sided(mean / (sd / F.sqrt(n.cast("double"))), n.cast("double") - 1)


def welch_t(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> tuple[Column, Column]:
    """t and the degrees of freedom of two means with sample variances of their own."""
    a, b = v1 / n1, v2 / n2
    return (m1 - m2) / F.sqrt(a + b), F.pow(a + b, 2) / (a * a / (n1 - 1) + b * b / (n2 - 1))


def paired_summary(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """by, n, means and deviations of a and b, mean_difference, dz, t and welch_t with its df: complete pairs only; missing where a deviation is zero. p-values: t_two_sided(t, n - 1) and of welch_t."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_d", F.col(a) - F.col(b))
    g = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[x for c in (a, b) for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd"))],
        F.avg("_d").alias("mean_difference"),
        F.stddev_samp("_d").alias("_sd"),
    )
    n, va, vb = F.col("n"), F.pow(f"{a}_sd", 2.0), F.pow(f"{b}_sd", 2.0)
    w, df_ = welch_t(F.col(f"{a}_mean"), va, n, F.col(f"{b}_mean"), vb, n)
    spread = (va + vb > 0) & (n > 1)
    return g.select(
        *by, "n", f"{a}_mean", f"{a}_sd", f"{b}_mean", f"{b}_sd", "mean_difference",
        F.when(F.col("_sd") > 0, F.col("mean_difference") / F.col("_sd")).alias("dz"),
        F.when(F.col("_sd") > 0, F.col("mean_difference") / (F.col("_sd") / F.sqrt(n))).alias("t"),
        F.when(spread, w).alias("welch_t"), F.when(spread, df_).alias("welch_df"),
    )


@F.pandas_udf(DoubleType())
def binomial_p(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return _vector(binomial_greater)(k, n, p)


@F.pandas_udf(DoubleType())
def pearson_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return _vector(lambda a, b: 2 * t_survival(abs(a) * math.sqrt((b - 2) / max(1e-300, 1 - a * a)), b - 2) if b > 2 else math.nan)(r, n)


def fisher_interval(r: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """95 % interval of a correlation."""
    at, se = F.atanh(clipped(r)), 1 / F.sqrt(F.when(n > 3, n - 3))
    return F.tanh(at - z * se), F.tanh(at + z * se)


def permutation_p(x: np.ndarray, y: np.ndarray, seed: int, n: int = 200_000, batch: int = 10_000) -> float:
    """Two-sided permutation p-value of a correlation, (exceeding + 1) / (n + 1), in batches of bounded memory."""
    x, y = (v - v.mean() for v in (np.asarray(x, float), np.asarray(y, float)))
    scale = math.sqrt(float(x @ x) * float(y @ y))
    if not scale > 0:
        return math.nan
    rng, seen, over = np.random.default_rng(seed), abs(float(x @ y)) / scale, 0
    for a in range(0, n, batch):
        k = min(batch, n - a)
        over += int((np.abs(rng.permuted(np.broadcast_to(y, (k, len(y))), axis=1) @ x) / scale >= seen - 1e-15).sum())
    return (over + 1) / (n + 1)


def sign_flip_p(d: np.ndarray, seed: int, exact_to: int = 20, n: int = 200_000, batch: int = 10_000) -> float:
    """Two-sided sign-flip p-value of a mean: all sign patterns up to exact_to values, else n drawn ones."""
    d = np.asarray(d, float)
    if not len(d):
        return math.nan
    seen = abs(d.mean()) - 1e-15
    over = total = 0
    if len(d) <= exact_to:
        total = 1 << len(d)
        for a in range(0, total, batch):
            bits = (np.arange(a, min(total, a + batch))[:, None] >> np.arange(len(d))) & 1
            over += int((np.abs((1 - 2 * bits) @ d / len(d)) >= seen).sum())
    else:
        rng, total = np.random.default_rng(seed), n
        for a in range(0, n, batch):
            signs = rng.integers(0, 2, (min(batch, n - a), len(d))) * 2 - 1
            over += int((np.abs(signs @ d / len(d)) >= seen).sum())
    return (over + 1) / (total + 1)

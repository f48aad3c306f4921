"""Windows over samples: fixed counts, strides, chunks, lags."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(df: DataFrame, by: list[str], order: list[str], out: str = "t") -> DataFrame:
    """Samples counted from 0 within each series."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def tumbling(df: DataFrame, by: list[str], t: str, width: int, tail: str = "drop") -> DataFrame:
    """Column window. Incomplete last windows are dropped ("drop"), or kept from half a width on ("half")."""
    out = df.withColumn("window", F.floor(F.col(t) / width).cast("long"))
    n = F.count(F.lit(1)).over(Window.partitionBy(*by, "window"))
    least = width if tail == "drop" else (width + 1) // 2
    return out.withColumn("_n", n).where(F.col("_n") >= least).drop("_n")


def sliding(df: DataFrame, by: list[str], t: str, width: int, stride: int) -> DataFrame:
    """Each sample in all full windows that hold it: columns window, start."""
    last = F.max(t).over(Window.partitionBy(*by))
    lo = F.greatest(F.lit(0), F.ceil((F.col(t) - width + 1) / stride)).cast("long")
    hi = F.least(F.floor(F.col(t) / stride), F.floor((F.col("_last") - width + 1) / stride)).cast("long")
    out = df.withColumn("_last", last).withColumn("_lo", lo).withColumn("_hi", hi).where("_hi >= _lo")
    return out.withColumn("window", F.explode(F.sequence("_lo", "_hi"))).withColumn("start", F.col("window") * stride).drop("_last", "_lo", "_hi")


def overlap_average(df: DataFrame, by: list[str], t: str, x: str, width: int, stride: int) -> DataFrame:
    """Mean over all windows that hold a sample of (x - its window's mean)."""
    w = sliding(df, by, t, width, stride)
    local = w.withColumn("_x", F.col(x) - F.avg(x).over(Window.partitionBy(*by, "window")))
    return local.groupBy(*by, t).agg(F.avg("_x").alias("value"), F.count(F.lit(1)).alias("windows"))


def lagged(df: DataFrame, by: list[str], t: str, x: str, lags: list[int], sign: str = "past") -> DataFrame:
    """Columns lag_k: the value k samples ago ("past"), or ahead ("future")."""
    w = Window.partitionBy(*by).orderBy(t)
    return df.withColumns({f"lag_{k}".replace("-", "m"): F.lag(x, k if sign == "past" else -k).over(w) for k in lags})


def lagged_design(x: np.ndarray, lags: list[int]) -> np.ndarray:
    """Rows t of [x[t + lag] for each lag], for the t at which all lags exist; x is [samples, channels]."""
    lo, hi = max(0, -min(lags)), len(x) - max(0, max(lags))
    return np.hstack([x[lo + k : hi + k] for k in lags]) if hi > lo else np.zeros((0, x.shape[1] * len(lags)))


def padded_design(stimulus: np.ndarray, first: int, last: int) -> np.ndarray:
    """Columns stimulus[t - lag] for lag first..last, zero where there is none."""
    out = np.zeros((len(stimulus), last - first + 1))
    for j, lag in enumerate(range(first, last + 1)):
        a, b = max(0, lag), min(len(stimulus), len(stimulus) + lag)
        out[a:b, j] = stimulus[a - lag : b - lag]
    return out


def chunks(df: DataFrame, n: str, size: int, context: int, least: int) -> DataFrame:
    """Chunks of a length: start every `size`, end with `context` more; those shorter than `least` are left out."""
    at = df.where(F.col(n) > 0).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1, F.lit(size).cast("long"))))
    return at.withColumn("stop", F.least(F.col("start") + size + context, F.col(n).cast("long"))).where(F.col("stop") - F.col("start") >= least)


def running_length(by: list[str], order: list[str], word: Column) -> Column:
    """Characters before a word in its text, words written without spaces."""
    return F.sum(F.length(word)).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.length(word)


def every(df: DataFrame, t: str, k: int, phase_by: str | None = None) -> DataFrame:
    """Every k-th sample; with phase_by the count restarts at each chunk."""
    return df.where(F.col(t) % k == 0) if phase_by is None else df.where((F.col(t) - F.min(t).over(Window.partitionBy(phase_by))) % k == 0)


def spread_out(n: int, k: int) -> list[int]:
    """k indices spread evenly over 0..n - 1, rounded down, each once."""
    return sorted({int(x) for x in np.linspace(0, n - 1, min(n, k))}) if n else []


def sampled_chunks(df: DataFrame, by: list[str], chunk: str, k: int) -> DataFrame:
    """Rows of k chunks of each series, spread evenly from the first to the last (places rounded half to even): all of them where there are no more. chunk counts from 0."""
    if k < 2:
        raise ValueError(f"{k} chunks: two at least")
    n = df.groupBy(*by).agg((F.max(chunk) + 1).cast("long").alias("_n")).withColumn("_m", F.least(F.col("_n"), F.lit(k)))
    place = F.when(F.col("_m") > 1, F.rint(F.col("_i") * (F.col("_n") - 1) / F.greatest(F.col("_m") - 1, F.lit(1)))).otherwise(0).cast("long")
    taken = n.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1))).select(*by, place.alias("_at")).distinct()
    same = [df[b].eqNullSafe(taken[b]) for b in by]
    return df.join(taken, [*same, df[chunk] == taken["_at"]], "left_semi")


def average_reference(x: Column) -> Column:
    """An array of channels less its mean."""
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double")) / F.size(x)
    return F.transform(x, lambda v: v.cast("double") - mean)


def column_z(df: DataFrame, by: list[str], x: str, out: str) -> DataFrame:
    """z-scores within a story (population deviation); a constant column is an error."""
    w = Window.partitionBy(*by)
    s = F.stddev_pop(x).over(w)
    return df.withColumn("_s", s).withColumn(out, F.when(F.col("_s") > 0, (F.col(x) - F.avg(x).over(w)) / F.col("_s")).otherwise(F.raise_error(F.lit("a constant column")).cast("double"))).drop("_s")


def ceil_length(seconds: Column, rate: float) -> Column:
    return F.ceil(seconds * rate).cast("long")

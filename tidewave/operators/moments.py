"""Means and deviations of vectors, in states that merge: (n, mean, m2), by the pairwise formula of Chan, Golub and LeVeque.

A state is one row with arrays, never a row an element. States of tasks, batches or days can be merged in any order and grouping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import merged_in_tree

STATE = "n long, mean array<double>, m2 array<double>"


def merged_pair(a: tuple, b: tuple) -> tuple[int, np.ndarray, np.ndarray]:
    """Two states as one."""
    (n, mean, m2), (k, other, more) = a, b
    if len(mean) != len(other):
        raise ValueError(f"vectors of {len(mean)} and of {len(other)} numbers")
    step = other - mean
    return n + k, mean + step * (k / (n + k)), m2 + more + step * step * (n * k / (n + k))


def state_of(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """The state of rows of vectors; numbers that aren't finite are an error."""
    if not np.isfinite(x).all():
        raise ValueError("vectors that aren't finite")
    mean = x.mean(0)
    return len(x), mean, ((x - mean) ** 2).sum(0)


def vector_moments(df: DataFrame, by: list[str], x: str, fan: int = 32) -> DataFrame:
    """by, n, mean, m2 of the array column x: reduced batch by batch in each task, then merged in a tree. Null vectors are left out; null keys are keys."""
    schema = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by) + ", " + STATE

    def out(held: dict) -> pd.DataFrame:
        return pd.DataFrame([(*k, n, mean.tolist(), m2.tolist()) for k, (n, mean, m2) in held.items()], columns=[*by, "n", "mean", "m2"])

    def reduce_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple] = {}
        for pdf in batches:
            for key, g in pdf.groupby(by, sort=False, dropna=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                new = state_of(np.stack(g[x].to_numpy()).astype(np.float64))
                held[key] = merged_pair(held[key], new) if key in held else new
            if len(held) > 1000:
                yield out(held)
                held = {}
        yield out(held)

    return merged_moments(df.select(*by, x).where(F.col(x).isNotNull()).mapInPandas(reduce_, schema), by, fan)


def merged_moments(states: DataFrame, by: list[str], fan: int = 32) -> DataFrame:
    """States of one key as one."""

    def merge(pdf: pd.DataFrame) -> list:
        rows = [(int(n), np.asarray(mean, float), np.asarray(m2, float)) for n, mean, m2 in zip(pdf["n"], pdf["mean"], pdf["m2"], strict=True)]
        whole = rows[0]
        for r in rows[1:]:
            whole = merged_pair(whole, r)
        return [whole[0], whole[1].tolist(), whole[2].tolist()]

    return merged_in_tree(states, by, merge, fan)


def finished_moments(states: DataFrame, floor: float = 1e-8) -> DataFrame:
    """mean and std (population, 1 below the floor) in place of the state's sums."""
    std = F.transform("m2", lambda v: F.sqrt(F.greatest(v / F.col("n"), F.lit(0.0))))
    return states.withColumn("std", F.transform(std, lambda s: F.when(s < floor, F.lit(1.0)).otherwise(s))).drop("m2")


def normalized(df: DataFrame, parameters: DataFrame, by: list[str], x: str, clip: float | None = None) -> DataFrame:
    """df with x standardised by its group's mean and std and clipped; a group without parameters is an error. parameters has a row a device."""
    fit = parameters.select(*by, F.col("mean").alias("_mean"), F.col("std").alias("_std"))
    joined = df.join(fit, by, "left")
    z = F.transform(F.arrays_zip(F.col(x).alias("x"), F.col("_mean").alias("m"), F.col("_std").alias("s")), lambda v: clipped_to((v["x"].cast("double") - v["m"]) / v["s"], clip))
    known = F.when(F.col("_mean").isNotNull(), z).otherwise(F.raise_error(F.lit("a group without parameters")).cast("array<double>"))
    return joined.withColumn(x, known).drop("_mean", "_std")


def clipped_to(z: Column, clip: float | None) -> Column:
    return z if not clip or clip <= 0 else F.greatest(F.lit(-float(clip)), F.least(F.lit(float(clip)), z))

"""Monte-Carlo tests dealt over tasks: batches of draws are rows, each with a generator of its own, and only counts come back.

A batch's generator is spawned from (seed, batch), so p-values are the same for any partitioning. A group's values are what a design has (participants, days); they
are sent once a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Draws of a test, and of a batch; numbers drawn at a time within a batch.
DRAWS, BATCH, CELLS = 200_000, 10_000, 4_000_000
#: Up to so many values all sign patterns are taken instead of draws.
EXACT = 20


def generator(seed: int, batch: int) -> np.random.Generator:
    return np.random.default_rng(np.random.SeedSequence(seed, spawn_key=(batch,)))


def dealt(total: DataFrame, by: list[str], batch: int) -> DataFrame:
    """A row for each batch of a group's draws: _batch, and _k draws in it. The number of partitions is given, since AQE would join them by their few bytes."""
    rows = total.withColumn("_batch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("draws") - 1) / batch))))
    n = int(total.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn("_k", F.least(F.lit(batch), F.col("draws") - F.col("_batch") * batch)).repartition(n, F.xxhash64(*by, "_batch"))


def _counted(groups: DataFrame, by: list[str], values: list[str], draws: Column, count: Callable[..., int], batch: int) -> DataFrame:
    """by, draws, over: groups (a row each) with their batches counted by count(values..., batch number, draws in it)."""
    schema = ", ".join(f"{b} {groups.schema[b].dataType.simpleString()}" for b in by) + ", _over long"
    total = groups.withColumn("draws", draws)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*key, count(*map(np.asarray, v), int(b), int(k))) for *key, b, k, v in zip(*(pdf[c] for c in by), pdf["_batch"], pdf["_k"], pdf[values].itertuples(index=False), strict=True)]
            yield pd.DataFrame(rows, columns=[*by, "_over"])

    over = dealt(total, by, batch).select(*by, "_batch", "_k", *values).mapInPandas(run, schema).groupBy(*by).agg(F.sum("_over").alias("over"))
    return total.select(*by, "draws").join(over, by)


def _listed(df: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """A row per group with its values as arrays, in order."""
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(v).cast("double").alias(v) for v in values]))).alias("_v"))
    return rows.select(*by, *[F.col(f"_v.{v}").alias(v) for v in values])


def sign_flips(df: DataFrame, by: list[str], order: list[str], difference: str, seed: int, draws: int = DRAWS, exact: int = EXACT, batch: int = BATCH) -> DataFrame:
    """by, n, mean, draws, p: two-sided sign-flip test of a mean of differences, (over + 1) / (draws + 1). All patterns of up to `exact` values, else draws. order must tell a group's rows apart."""
    d = _listed(df.where(F.col(difference).isNotNull()), by, order, [difference])

    def count(d: np.ndarray, number: int, k: int) -> int:
        least, n, over = abs(d.mean()) - 1e-15, len(d), 0
        rng = generator(seed, number)
        for a in range(0, k, max(1, CELLS // n)):
            m = min(max(1, CELLS // n), k - a)
            bits = (np.arange(number * batch + a, number * batch + a + m)[:, None] >> np.arange(n)) & 1 if n <= exact else rng.integers(0, 2, (m, n))
            over += int((np.abs((2 * bits - 1) @ d / n) >= least).sum())
        return over

    n = F.size(difference)
    all_of = F.when(n <= exact, F.pow(F.lit(2.0), n).cast("long")).otherwise(F.lit(draws).cast("long"))
    found = _counted(d, by, [difference], all_of, count, batch)
    mean = F.aggregate(difference, F.lit(0.0), lambda s, x: s + x) / n
    return d.select(*by, n.alias("n"), mean.alias("mean")).join(found, by).select(*by, "n", "mean", "draws", ((F.col("over") + 1) / (F.col("draws") + 1)).alias("p"))


def permutations(df: DataFrame, by: list[str], order: list[str], x: str, y: str, seed: int, draws: int = DRAWS, batch: int = BATCH) -> DataFrame:
    """by, n, r, draws, p: two-sided permutation test of a correlation. Where x or y is constant r and p are missing."""
    both = _listed(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), by, order, [x, y])

    def count(x: np.ndarray, y: np.ndarray, number: int, k: int) -> int:
        x, y = x - x.mean(), y - y.mean()
        scale = np.sqrt((x @ x) * (y @ y))
        if not scale > 0:
            return 0
        least, over, rng, step = abs(x @ y) / scale - 1e-15, 0, generator(seed, number), max(1, CELLS // len(x))
        for a in range(0, k, step):
            over += int((np.abs(rng.permuted(np.broadcast_to(y, (min(step, k - a), len(y))), axis=1) @ x) / scale >= least).sum())
        return over

    found = _counted(both, by, [x, y], F.lit(draws).cast("long"), count, batch)
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    r = df.where(a.isNotNull() & b.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.covar_pop(a, b).alias("_c"), (F.stddev_pop(a) * F.stddev_pop(b)).alias("_s"))
    r = r.select(*by, "n", F.when(F.col("_s") > 0, F.col("_c") / F.col("_s")).alias("r"))
    return r.join(found, by).select(*by, "n", "r", "draws", F.when(F.col("r").isNotNull(), (F.col("over") + 1) / (F.col("draws") + 1)).alias("p"))

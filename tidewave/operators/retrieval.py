"""Splits, candidate draws and N-way retrieval; leave-one-out correlation between subjects."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.missing import ratio_or_zero
from ..functions.selection import cut
from ..functions.statistics import binomial_p

#: Samples are numbered within spans of so many values of t.
SPAN = 4096


def split(trials: list[int], seed: int, subject: int, group: int, validation: int = 2, test: int = 2) -> dict[int, str]:
    """Train, validation and test trials; the draw depends on seed, subject and group only."""
    order = np.array(sorted(trials))
    np.random.default_rng(np.random.SeedSequence([seed, subject, group])).shuffle(order)
    roles = ["test"] * test + ["validation"] * validation
    if len(order) <= len(roles):
        raise ValueError(f"subject {subject}, group {group}: {len(order)} trials leave none to train on")
    return {int(t): roles[i] if i < len(roles) else "train" for i, t in enumerate(order)}


def draw_candidates(n_windows: int, starts: list[int], width: int, n: int, seed: int | list[int]) -> list[list[int] | None]:
    """For each window the order of itself and n - 1 windows that don't overlap it; None, without a draw, where there are too few."""
    rng, out = np.random.default_rng(seed), []
    for i in range(n_windows):
        pool = [j for j in range(n_windows) if starts[j] + width <= starts[i] or starts[j] >= starts[i] + width]
        if len(pool) < n - 1:
            out.append(None)
            continue
        chosen = [i, *rng.choice(pool, n - 1, replace=False).tolist()]
        out.append([int(chosen[k]) for k in rng.permutation(n)])
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def array_correlation(a: Column, b: Column) -> Column:
    """Pearson r of two arrays; 0 where one is constant."""
    n = F.size(a)
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double")) / n
    cross = dot(a, b) - n * mean(a) * mean(b)
    var = lambda x: F.greatest(F.lit(0.0), dot(x, x) - n * mean(x) * mean(x))
    return ratio_or_zero(cross, F.sqrt(var(a) * var(b)))


def ranked(scored: DataFrame, query: list[str], position: str, score: str, positive: str) -> DataFrame:
    """Per query: rank of the positive (1 + candidates strictly above it), the first best position, correct, mean of the negatives, and the margin over the largest of them."""
    g = scored.groupBy(*query).agg(
        F.max(F.when(F.col(positive), F.col(score))).alias("positive_score"),
        F.max(F.when(F.col(positive), F.col(position))).alias("positive_label"),
        F.min(F.struct((-F.col(score)).alias("s"), F.col(position).alias("p"))).alias("_best"),
        F.collect_list(F.when(~F.col(positive), F.col(score))).alias("_neg"),  # n - 1 candidates
    )
    neg = F.aggregate(F.array_sort("_neg"), F.lit(0.0), lambda s, v: s + v) / F.size("_neg")
    return g.select(*query, "positive_score", "positive_label", F.col("_best.p").alias("predicted_label"), (1 + F.size(F.expr("filter(_neg, x -> x > positive_score)"))).alias("positive_rank"), (F.col("_best.p") == F.col("positive_label")).cast("int").alias("correct"), neg.alias("mean_negative"), (F.col("positive_score") - F.array_max("_neg")).alias("margin"))


def drawn(k: int, n: int, seed: int | list[int], apart: int = 1) -> Iterator[tuple[int, list[int]]]:
    """draw_candidates for k windows at equal distances of which those less than `apart` numbers away overlap: by index arithmetic, without a pool."""
    rng = np.random.default_rng(np.random.SeedSequence(seed))
    for i in range(k):
        left = max(0, i - apart + 1)
        pool = left + max(0, k - i - apart)
        if pool < n - 1:
            continue
        j = rng.choice(pool, n - 1, replace=False)
        chosen = [i, *np.where(j < left, j, j - left + i + apart).tolist()]
        yield i, [int(chosen[m]) for m in rng.permutation(n)]


def _number(v) -> int:
    """A part of a key as a number for a seed: integers as they are, all else by the CRC of its text."""
    return int(v) % (1 << 64) if isinstance(v, int) else zlib.crc32(str(v).encode())


def retrieval_windows(prediction: DataFrame, by: list[str], t: str, predicted: str, target: str, width: int, n: int, seed: int, stride: int | None = None, width_ms: int | None = None) -> DataFrame:
    """N-way retrieval over the full windows of each trial: one row per window with its candidates, scores, rank and margin.

    t is a number. Windows begin every `stride` samples (by default `width`). A trial's draws are one sequence, seeded by [seed,
    the parts of its key, the width in milliseconds (by default in samples)], so they depend on nothing else; windows without n - 1 others that don't overlap
    them are left out, and so are windows of fewer than two samples. Samples are numbered within spans of t, windows are put together by key and number, and meet their candidates in a join, so no trial is gathered.
    """
    if n < 2:
        raise ValueError(f"{n} candidates: two at least")
    stride = stride or width
    g = F.struct(*by)
    x = prediction.select(g.alias("g"), F.floor(F.col(t) / SPAN).alias("span"), F.col(t).alias("t"), F.col(predicted).alias("p"), F.col(target).alias("y"))
    spans = x.groupBy("g", "span").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("g").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("g", F.coalesce("span", F.lit(-1)).alias("span"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    x = x.withColumn("span", F.coalesce("span", F.lit(-1))).withColumn("i", F.row_number().over(Window.partitionBy("g", "span").orderBy("t")) - 1)
    x = x.join(spans, ["g", "span"]).withColumn("i", F.col("i") + F.col("before"))
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - width + 1) / stride)).cast("int")
    x = x.withColumn("lo", first).withColumn("hi", F.floor(F.col("i") / stride).cast("int")).where("hi >= lo").withColumn("w", F.explode(F.sequence("lo", "hi")))
    parts = x.groupBy("g", "w").agg(F.array_sort(F.collect_list(F.struct("i", "p", "y"))).alias("v"))  # width rows
    flat = lambda c: F.flatten(F.transform("v", lambda r: F.transform(r[c], lambda v: v.cast("double"))))
    centred = lambda c: F.transform(c, lambda v: v - F.aggregate(c, F.lit(0.0), lambda s, u: s + u) / F.size(c))
    full = parts.where((F.size("v") == width) & F.lit(width > 1)).select("g", "w", flat("p").alias("p"), flat("y").alias("y"))
    # built once, with both sides: draws, queries and candidates all read it
    full = cut(full.select("g", "w", F.explode(F.array(F.struct(centred(F.col("p")).alias("a"), centred(F.col("y")).alias("b")))).alias("x")).select("g", "w", "x.a", "x.b"), "windows")
    side = lambda name: full.select("g", F.col("w").alias(f"w_{name}"), name)
    apart = -(-width // stride)

    def draws(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, k in zip(pdf["key"], pdf["k"], strict=True):
                own = json.loads(key)
                numbers = drawn(int(k), n, [seed, *[_number(own.get(b)) for b in by], width if width_ms is None else width_ms], apart)
                while rows := list(islice(numbers, 10_000)):
                    yield pd.DataFrame([(key, i, c) for i, c in rows], columns=["key", "w_a", "candidates"])

    trials = full.groupBy("g").agg((F.max("w") + 1).alias("k")).select("g", F.to_json("g").alias("key"), "k")
    dealt = trials.select("key", "k").repartition("key").mapInPandas(draws, "key string, w_a int, candidates array<int>")
    asked = dealt.join(trials.select("key", "g"), "key").select("g", "w_a", F.posexplode("candidates").alias("at", "w_b"))
    j = asked.join(side("a"), ["g", "w_a"]).join(side("b"), ["g", "w_b"])
    den = F.sqrt(dot(F.col("a"), F.col("a")) * dot(F.col("b"), F.col("b")))
    j = j.select("g", "w_a", "at", "w_b", F.when(den > 1e-12, dot(F.col("a"), F.col("b")) / den).otherwise(0.0).alias("score"))
    q = j.groupBy("g", "w_a").agg(F.array_sort(F.collect_list(F.struct("at", "w_b", "score"))).alias("c"))  # n candidates
    q = q.select(F.col("g.*"), F.col("w_a").alias("segment"), F.col("c.w_b").alias("candidates"), F.col("c.score").alias("scores"))
    q = q.withColumn("positive_label", (F.array_position("candidates", F.col("segment")) - 1).cast("int")).withColumn("predicted_label", (F.array_position("scores", F.array_max("scores")) - 1).cast("int"))
    own = F.element_at("scores", F.col("positive_label") + 1)
    others = F.filter("scores", lambda v, i: i != F.col("positive_label"))
    rank = (1 + F.size(F.filter(others, lambda v: v > own))).cast("int")
    mean = F.aggregate(others, F.lit(0.0), lambda s, v: s + v) / F.size(others)
    return q.select(*by, "segment", (F.col("segment").cast("long") * stride).alias("start"), "candidates", "scores", "positive_label", "predicted_label", rank.alias("positive_rank"), (F.col("predicted_label") == F.col("positive_label")).cast("int").alias("correct"), own.alias("positive_score"), mean.alias("mean_negative"), (own - F.array_max(others)).alias("margin"))


def summary(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """Accuracy, mean reciprocal rank and mean scores per key, with the one-sided binomial p-value against chance."""
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("windows"), F.sum("correct").alias("correct"), F.avg("correct").alias("accuracy"), F.avg(1 / F.col("positive_rank")).alias("mrr"), F.avg("positive_score").alias("mean_positive"), F.avg("mean_negative").alias("mean_negative"), F.avg("margin").alias("mean_margin"), F.lit(1.0 / n).alias("chance"))
    return out.withColumn("binomial_p", binomial_p(F.col("correct").cast("double"), F.col("windows").cast("double"), F.col("chance")))


def leave_one_out(series: DataFrame, unit: list[str], subject: str, t: str, x: str) -> DataFrame:
    """r of each subject with the mean of all others in each unit (trial, channel): the total less oneself, then sums of products.

    Samples are z-scored per subject and unit first. Units with one subject, or constant series, give no r.
    """
    own = Window.partitionBy(*unit, subject)
    z = series.withColumn("_s", F.stddev_pop(x).over(own)).where("_s > 0").withColumn("_z", (F.col(x) - F.avg(x).over(own)) / F.col("_s"))
    at = Window.partitionBy(*unit, t)
    z = z.withColumn("_n", F.count(F.lit(1)).over(at)).withColumn("_o", F.sum("_z").over(at) - F.col("_z")).where("_n > 1").withColumn("_o", F.col("_o") / (F.col("_n") - 1))
    return z.groupBy(*unit, subject).agg(F.corr("_z", "_o").alias("r"), F.count(F.lit(1)).alias("n"))

"""Exact quantiles, ranks and suffix minima of groups of any size."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions import selection
from tidewave.functions import statistics as st
from tidewave.operators import quality

QS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def skewed(seed=1):
    """A group of most rows, one of equal values, one of values over hundreds of orders of magnitude, small ones, a null key and missing values."""
    rng = np.random.default_rng(seed)
    rows = [("big", float(v)) for v in rng.normal(size=6000)] + [("equal", 7.0)] * 900 + [("wide", float(v)) for v in 10.0 ** rng.uniform(-290, 290, 800) * rng.choice([-1, 1], 800)]
    rows += [("ties", float(v)) for v in rng.integers(0, 4, 500)] + [("one", 3.0), ("two", 1.0), ("two", 2.0), (None, 5.0), (None, -5.0), (None, 0.5), ("none", None), ("none", float("nan"))]
    rows += [("big", None), ("big", float("nan")), ("ends", float("inf")), ("ends", float("-inf")), ("ends", 0.0)]
    random.Random(seed).shuffle(rows)
    return rows


@pytest.mark.parametrize("limit,grid", [(100_000, 256), (300, 16)])
def test_exact_quantiles(spark, limit, grid):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, x double").repartition(9)
    got = {r["k"]: r for r in selection.exact_quantiles(df, ["k"], "x", QS, limit, grid).collect()}
    own = {}
    for k, v in rows:
        if v is not None and v == v:
            own.setdefault(k, []).append(v)
    assert got.keys() == own.keys() and "none" not in got
    for k, v in own.items():
        assert got[k]["n"] == len(v)
        if k != "ends":
            np.testing.assert_allclose(got[k]["quantiles"], np.quantile(v, QS), rtol=1e-12)
    assert got["ends"]["quantiles"][3] == 0.0 and got["ends"]["quantiles"][0] == float("-inf")
    due = {r["k"]: r["q"] for r in df.where("x IS NOT NULL AND NOT isnan(x)").groupBy("k").agg(F.percentile("x", F.array(*map(F.lit, QS))).alias("q")).collect()}
    assert all(got[k]["quantiles"] == pytest.approx(due[k], rel=1e-12) for k in own if k != "ends")


def test_no_groups_and_empty_tables(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    assert selection.exact_median(df, [], "x", "m").first().asDict() == {"n": 11, "m": 5.0}
    assert selection.exact_quantiles(df.where("x > 99"), [], "x", [0.5]).collect() == []
    assert quality.robust_statistics(df.where("x > 99").withColumn("k", F.lit(1)), ["k"], "x").collect() == []



def test_one_list_is_dealt_to_many_tasks(spark):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.uniform(size=3000), np.full(1000, 0.25)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "i int, p double")
    rows = selection.in_ranges(df, [F.col("p"), F.xxhash64("i")], 10)
    assert rows.select("_part").distinct().count() == 10 and max(r["count"] for r in rows.groupBy("_part").count().collect()) < 800
    got = {r["i"]: r["q"] for r in st.benjamini_hochberg(df, "p", "q", partitions=10).collect()}
    order = np.argsort(p, kind="stable")
    ranked = p[order] * len(p) / np.arange(1, len(p) + 1)
    due = np.empty(len(p))
    due[order] = np.minimum(np.minimum.accumulate(ranked[::-1])[::-1], 1)
    np.testing.assert_allclose([got[i] for i in range(len(p))], due, rtol=1e-12)


@pytest.mark.parametrize("parts", [1, 3, 13])
def test_ranks_and_suffix_minima_within_groups(spark, parts):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None, "c"]), i, rng.random()) for i in range(400)] + [("lone", 1000, 0.5)]
    df = spark.createDataFrame(rows, "k string, i int, x double")
    got = {r["i"]: r["r"] for r in selection.ranked_rows(df, ["k"], [F.col("i")], "r", parts).collect()}
    ranged = selection.in_ranges(df, [F.col("k"), F.col("i")], parts)
    least = {r["i"]: r["m"] for r in selection.with_suffix_minimum(ranged, ["k"], F.col("x"), "m").collect()}
    for k in ("a", "b", None, "c", "lone"):
        own = sorted((i, x) for g, i, x in rows if g == k)
        assert [got[i] for i, _ in own] == list(range(1, len(own) + 1))
        assert [least[i] for i, _ in own] == [min(x for _, x in own[j:]) for j in range(len(own))]

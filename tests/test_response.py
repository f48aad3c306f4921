"""Lagged response models against plain designs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.operators import linear, response

FIRST, LAGS = -3, 10


def design(x):
    """The plain definition: all full windows, latest sample first, columns standardised."""
    w = np.lib.stride_tricks.sliding_window_view(x, LAGS)[:, ::-1]
    return (w - w.mean(0)) / w.std(0)


def made(seed, n=6, subjects=2, channels=3):
    """Stimuli of n stories, and noisy responses a little longer than they are."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(size=(subjects, LAGS, channels))
    stimuli, responses = {}, {}
    for story in range(1, n + 1):
        x = rng.normal(size=rng.integers(60, 160)) * 5 + 1000
        stimuli[story] = x
        for s in range(subjects):
            y = rng.normal(size=(len(x) + 4, channels)) * 0.5 + 7
            y[FIRST + LAGS - 1 : len(x) + FIRST] += design(x) @ weights[s]
            responses[s, story] = y
    return stimuli, responses


def frames(spark, stimuli, responses):
    x = [(("a" if k < 4 else "b") if len(stimuli) > 6 else "a", k, t, float(v)) for k, x in stimuli.items() for t, v in enumerate(x)]
    y = [(f"s{s}", k, t, [float(v) for v in row]) for (s, k), ys in responses.items() for t, row in enumerate(ys)]
    return spark.createDataFrame(x, "day string, story int, t long, x double").repartition(5), spark.createDataFrame(y, "subject string, story int, t int, y array<double>").repartition(7)


@pytest.mark.parametrize("size", [10, 17, 64, 4096])
def test_products_are_those_of_the_plain_design(spark, size):
    stimuli, responses = made(1)
    x, y = frames(spark, stimuli, responses)
    chunks = response.stimulus_chunks(x, ["story"], "t", "x", LAGS, size)
    designs = response.lag_products(chunks, ["story"], LAGS, size)
    found = {r["story"]: r for r in designs.collect()}
    assert found.keys() == stimuli.keys()
    for k, v in stimuli.items():
        d = design(v)
        assert found[k]["n"] == len(d)
        np.testing.assert_allclose(np.reshape(found[k]["xx"], (LAGS, LAGS)), d.T @ d, atol=1e-9 * len(d))
    sums = response.standardised(response.cross_products(y, chunks, ["subject"], ["story"], "t", "y", FIRST, LAGS, size), designs, ["story"], LAGS)
    rows = sums.collect()
    assert len(rows) == len(responses)
    for r in rows:
        v = stimuli[r["story"]]
        d, ys = design(v), responses[int(r["subject"][1:]), r["story"]][FIRST + LAGS - 1 : len(v) + FIRST]
        z = (ys - ys.mean(0)) / ys.std(0)
        np.testing.assert_allclose(np.reshape(r["xy"], (LAGS, -1)), d.T @ z, atol=1e-9 * len(d))
        np.testing.assert_allclose(r["y_std"], ys.std(0), rtol=1e-12)
        assert r["yss"] == [float(len(d))] * 3


ALPHAS = [0.1, 10.0, 1000.0]


def test_cross_validation_shares_operators_and_follows_the_definition(spark):
    stimuli, responses = made(2, n=9)
    x, y = frames(spark, stimuli, responses)
    story = ["day", "story"]
    chunks = response.stimulus_chunks(x, story, "t", "x", LAGS, 50)
    designs = response.lag_products(chunks, story, LAGS, 50)
    days = x.select("story", "day").distinct()
    sums = response.standardised(response.cross_products(y.join(days, "story"), chunks, ["subject"], story, "t", "y", FIRST, LAGS, 50), designs, story, LAGS)
    plans = response.fold_plans(designs, ["day"], "story", 3, ALPHAS)
    scores = response.cross_validated(sums, plans, ["subject"], ["day"], "story", ALPHAS)
    rows = scores.collect()
    assert len(rows) == len(responses)
    pooled = {(r["subject"], r["day"], r["channel"]): r["r"] for r in response.pooled(scores, ["subject", "day"]).collect()}
    for s in (0, 1):
        for day in "ab":
            ids = [k for k in stimuli if ("a" if k < 4 else "b") == day]
            own = {}
            for k in ids:
                d, ys = design(stimuli[k]), responses[s, k][FIRST + LAGS - 1 : len(stimuli[k]) + FIRST]
                z = (ys - ys.mean(0)) / ys.std(0)
                own[k] = {"n": float(len(d)), "sx": d.sum(0), "xx": d.T @ d, "sy": z.sum(0), "xy": d.T @ z, "yy": (z * z).sum(0)}
            due = linear.nested_cv(own, ALPHAS, 3)
            got = {r["story"]: r for r in rows if r["subject"] == f"s{s}" and r["day"] == day}
            for fold in due:
                for k, r in zip(fold["stories"], fold["r"], strict=True):
                    assert got[k]["fold"] == fold["fold"] and got[k]["alpha"] == fold["alpha"]
                    np.testing.assert_allclose(got[k]["r"], r, atol=1e-9)
                    np.testing.assert_allclose(got[k]["inner_score"], fold["score"], atol=1e-9)
            np.testing.assert_allclose([pooled[f"s{s}", day, c] for c in range(3)], linear.pooled_r(due), atol=1e-9)


def test_synthetic_recovery(spark):
    """Responses that are a lagged design with little noise are predicted with r of 0.95 at least."""
    rng = np.random.default_rng(7)
    stimuli = {k: rng.normal(size=900) for k in range(5)}
    weights = rng.normal(scale=0.2, size=(LAGS, 4))
    responses = {}
    for k, x in stimuli.items():
        y = np.zeros((900, 4))
        y[FIRST + LAGS - 1 : 900 + FIRST] = design(x) @ weights
        responses[0, k] = y + rng.normal(scale=0.1, size=y.shape)
    x, y = frames(spark, stimuli, responses)
    chunks = response.stimulus_chunks(x, ["day", "story"], "t", "x", LAGS, 128)
    designs = response.lag_products(chunks, ["day", "story"], LAGS, 128)
    sums = response.standardised(response.cross_products(y.withColumn("day", F.lit("a")), chunks, ["subject"], ["day", "story"], "t", "y", FIRST, LAGS, 128), designs, ["day", "story"], LAGS)
    scores = response.cross_validated(sums, response.fold_plans(designs, ["day"], "story", 5, [100.0]), ["subject"], ["day"], "story", [100.0])
    assert min(min(r["r"]) for r in scores.collect()) >= 0.95
    weights_of = linear.response_waveform(response.as_sums(sums, designs, ["day", "story"]), ["subject", "day"], "story", [100.0])
    w = weights_of.orderBy("lag").collect()
    assert len(w) == LAGS and w[0]["cv_r"] > 0.9 and w[0]["alpha"] == 100.0


@pytest.mark.parametrize("fault", ["gap", "nan", "constant", "short", "short response", "constant response"])
def test_faults_are_errors(spark, fault):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=60), rng.normal(size=(60, 2))
    if fault == "nan":
        x[5] = np.nan
    elif fault == "constant":
        x[:] = 3.0
    elif fault == "short":
        x = x[: LAGS + 1]
    elif fault == "short response":
        y = y[:50]
    elif fault == "constant response":
        y[:, 1] = 4
    xs, ys = frames(spark, {1: x}, {(0, 1): y})
    if fault == "gap":
        xs = xs.where("t <> 30")
    chunks = response.stimulus_chunks(xs, ["story"], "t", "x", LAGS, 20)
    designs = response.lag_products(chunks, ["story"], LAGS, 20)
    with pytest.raises(Exception, match="finite|constant|valid|gaps"):
        response.standardised(response.cross_products(ys, chunks, ["subject"], ["story"], "t", "y", FIRST, LAGS, 20), designs, ["story"], LAGS).collect()


@pytest.mark.parametrize("fan", [2, 32])
def test_added_in_a_tree(spark, fan):
    rows = [(i % 3, float(i), [float(i), 1.0]) for i in range(100)]
    got = linear.added(spark.createDataFrame(rows, "k int, n double, v array<double>").repartition(9), ["k"], fan).collect()
    assert {(r["k"], r["n"], tuple(r["v"])) for r in got} == {(k, float(sum(range(k, 100, 3))), (float(sum(range(k, 100, 3))), float(len(range(k, 100, 3))))) for k in range(3)}

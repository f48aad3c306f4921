"""Moments of vectors that merge in any way, and tests by draws that are dealt over tasks."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions import draws
from tidewave.operators import moments


def rows_of(x, device="a"):
    return [(device, i, [float(v) for v in row]) for i, row in enumerate(x)]


@pytest.mark.parametrize("parts,fan", [(1, 32), (7, 2), (5, 3)])
def test_moments_are_numpys_however_they_are_merged(spark, parts, fan):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(101, 7)) * 3 + 1e6  # far from zero, where sums of squares cancel
    df = spark.createDataFrame([*rows_of(x), *rows_of(x[:5] * 0 + 2, "constant"), *rows_of(x[:1], None), ("a", 999, None)], "device string, i int, x array<double>").repartition(parts)
    at_once = moments.vector_moments(df, ["device"], "x", fan)
    some = [moments.vector_moments(df.where(c), ["device"], "x") for c in ("i < 13", "i >= 13 AND i < 80", "i >= 80")]
    in_steps = moments.merged_moments(some[2].unionByName(moments.merged_moments(some[0].unionByName(some[1]), ["device"])), ["device"], fan)
    for states in (at_once, in_steps):
        got = {r["device"]: r for r in moments.finished_moments(states).collect()}
        assert got["a"]["n"] == 101 and got["constant"]["std"] == [1.0] * 7 and got[None]["n"] == 1
        np.testing.assert_allclose(got["a"]["mean"], x.mean(0), rtol=1e-14)
        np.testing.assert_allclose(got["a"]["std"], x.std(0), rtol=1e-9)


def test_normalized_by_device(spark):
    x = np.random.default_rng(1).normal(size=(40, 3)) * 5 + 2
    df = spark.createDataFrame([*rows_of(x[:20], "a"), *rows_of(x[20:], "b")], "device string, i int, x array<double>")
    fit = moments.finished_moments(moments.vector_moments(df, ["device"], "x"))
    got = {(r["device"], r["i"]): r["x"] for r in moments.normalized(df, fit, ["device"], "x", 1.5).collect()}
    z = (x[:20] - x[:20].mean(0)) / x[:20].std(0)
    np.testing.assert_allclose([got["a", i] for i in range(20)], np.clip(z, -1.5, 1.5), atol=1e-12)
    with pytest.raises(Exception, match="without parameters"):
        moments.normalized(df, fit.where("device = 'a'"), ["device"], "x").collect()


@pytest.mark.parametrize("bad", [[[1.0, float("nan")]], [[1.0, 2.0], [1.0]]])
def test_faulty_vectors_are_errors(spark, bad):
    df = spark.createDataFrame([("a", 0, v) for v in bad], "device string, i int, x array<double>").repartition(1)
    with pytest.raises(Exception, match="finite|shape|numbers"):
        moments.vector_moments(df, ["device"], "x").collect()


def test_moments_of_nothing(spark):
    assert moments.vector_moments(spark.createDataFrame([], "device string, x array<double>"), ["device"], "x").collect() == []


def test_sign_flips(spark):
    rng = np.random.default_rng(2)
    few, many = rng.normal(size=9) + 0.6, rng.normal(size=40) + 0.25
    df = spark.createDataFrame([("few", i, float(v)) for i, v in enumerate(few)] + [("many", i, float(v)) for i, v in enumerate(many)] + [("many", 99, None), ("zero", 0, 0.0)], "k string, i int, d double")
    results = [{r["k"]: r for r in draws.sign_flips(df.repartition(p), ["k"], ["i"], "d", 7, 20_000, batch=b).collect()} for p, b in ((1, 64), (6, 64), (3, 5000))]
    signs = np.array(list(itertools.product((-1, 1), repeat=9)))
    due = ((np.abs(signs @ few / 9) >= abs(few.mean()) - 1e-15).sum() + 1) / 513
    for got in results:
        assert got["few"]["p"] == due and got["few"]["draws"] == 512 and got["zero"]["p"] == 1.0 and got["many"]["n"] == 40
        t = many.mean() / (many.std(ddof=1) / np.sqrt(40))
        normal = math.erfc(abs(t) / 2**0.5)
        assert got["many"]["draws"] == 20_000 and got["many"]["p"] == pytest.approx(normal, abs=0.03)
    assert results[0]["many"]["p"] == results[1]["many"]["p"]  # whatever the partitions


def test_permutations(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=6)
    y = x + rng.normal(size=6)
    df = spark.createDataFrame([("k", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [("flat", i, 1.0, float(i)) for i in range(4)], "k string, i int, x double, y double")
    results = [{r["k"]: r for r in draws.permutations(df.repartition(p), ["k"], ["i"], "x", "y", 3, 60_000).collect()} for p in (1, 5)]
    r = np.corrcoef(x, y)[0, 1]
    exact = np.mean([abs(np.corrcoef(x, p)[0, 1]) >= abs(r) - 1e-12 for p in itertools.permutations(y)])
    for got in results:
        assert got["k"]["r"] == pytest.approx(r) and got["k"]["p"] == pytest.approx(exact, abs=0.01) and got["flat"]["p"] is None
    assert results[0]["k"]["p"] == results[1]["k"]["p"]


def test_batches_are_dealt_to_many_tasks(spark):
    df = spark.createDataFrame([("k", i, float(i)) for i in range(30)], "k string, i int, d double")
    assert draws.sign_flips(df, ["k"], ["i"], "d", 1, 2000, batch=100).first()["draws"] == 2000
    rows = draws.dealt(spark.createDataFrame([("k", 2050)], "k string, draws long"), ["k"], 100)
    assert rows.agg(F.count(F.lit(1)), F.sum("_k")).first()[:] == (21, 2050)
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() == 4

"""The reference's own operators on small synthetic inputs."""

import json
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions import missing, names
from tidewave.functions import statistics as st
from tidewave.operators import audit, intervals, linear, quality, relational, retrieval, signal, windows
from tidewave.sources import readers, sinks
from tidewave.streaming import quality_stream


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_lagged_designs():
    x = np.array([[10 * t + c for c in range(2)] for t in range(6)], float)
    d = windows.lagged_design(x, [0, 2])
    assert d.shape == (4, 4) and d[0].tolist() == [0, 1, 20, 21] and d[-1].tolist() == [30, 31, 50, 51]
    p = windows.padded_design(np.array([1.0, 2, 3]), -1, 1)
    assert p.tolist() == [[2, 1, 0], [3, 2, 1], [0, 3, 2]]


def test_splits_are_whole_disjoint_and_repeatable():
    a = retrieval.split(list(range(1, 18)), 42, 7, 1)
    assert a == retrieval.split(list(range(1, 18))[::-1], 42, 7, 1) and a != retrieval.split(list(range(1, 18)), 42, 8, 1)
    assert [sum(v == r for v in a.values()) for r in ("train", "validation", "test")] == [13, 2, 2] and set(a) == set(range(1, 18))
    with pytest.raises(ValueError, match="none to train"):
        retrieval.split([1, 2, 3, 4], 42, 7, 1)


def test_ridge_recovers_weights():
    rng = np.random.default_rng(11)
    w = rng.normal(size=(5, 3))
    make = lambda n: (lambda x: {"n": float(n), "sx": x.sum(0), "xx": x.T @ x, "sy": (x @ w + 1).sum(0), "xy": x.T @ (x @ w + 1), "yy": ((x @ w + 1) ** 2).sum(0)})(rng.normal(size=(n, 5)))
    alpha, got, b, _ = linear.ridge_path(make(500), make(120), [1e-8, 1e-2])
    assert alpha == 1e-8 and np.allclose(got, w, atol=1e-6) and np.allclose(b, 1, atol=1e-6)


def as_sums(x, y):
    return {"n": float(len(x)), "sx": x.sum(0), "xx": x.T @ x, "sy": y.sum(0), "xy": x.T @ y, "yy": (y * y).sum(0)}


def test_a_doubled_column_shares_its_weight():
    x = np.random.default_rng(1).normal(size=(200, 1)).repeat(2, 1)
    _, w, b, _ = linear.ridge_path(as_sums(x, 2 * x[:, :1]), as_sums(x[:50], 2 * x[:50, :1]), [0.0])
    assert np.allclose(w.ravel(), [1, 1], atol=1e-6) and abs(b[0]) < 1e-6


def test_the_correlation_metric_is_one_cosine_around_training_means():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(300, 3)) + 1, rng.normal(size=(300, 2))
    y += x[:, :2]
    a, v = slice(0, 200), slice(200, 300)
    _, _, _, scores = linear.ridge_path(as_sums(x[a], y[a]), as_sums(x[v], y[v]), [0.1, 10.0], "correlation")
    mx, my = x[a].mean(0), y[a].mean(0)
    for alpha, s in zip([0.1, 10.0], scores, strict=True):
        c = (x[a] - mx).T
        w = np.linalg.solve(c @ c.T / 200 + alpha * np.eye(3), c @ (y[a] - my) / 200)
        p, q = ((x[v] - mx) @ w).ravel(), (y[v] - my).ravel()
        assert s == pytest.approx(p @ q / math.sqrt((p @ p) * (q @ q)))


def test_sums_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(101, 4)), rng.normal(size=(101, 2))
    df = spark.createDataFrame([("k", a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "k string, x array<double>, y array<double>")
    for n in (1, 7):
        s = linear.sums_of(linear.merged_sums(linear.partial_sums(df.repartition(n), ["k"], "x", "y"), ["k"]).first())
        assert s["n"] == 101 and np.allclose(s["xx"], x.T @ x) and np.allclose(s["xy"], x.T @ y) and np.allclose(s["yy"], (y * y).sum(0))
    c = linear.centred(s)
    w = np.linalg.solve(c["xx"] + 2 * np.eye(4), c["xy"])
    assert np.allclose(linear.ridge_solutions(c["xx"], c["xy"], [2.0])[0], w)
    p = (x - x.mean(0)) @ w
    assert np.allclose(linear.correlations(c, w), [np.corrcoef(p[:, j], y[:, j])[0, 1] for j in range(2)])


def test_response_model_recovers_correlation():
    rng = np.random.default_rng(20260907)
    s, w = rng.normal(size=5000), rng.normal(scale=0.2, size=(10, 4))
    x = windows.padded_design(s, -3, 6)
    y = x @ w + rng.normal(scale=0.15, size=(5000, 4))
    stories = {}
    for k in range(10):
        stories[k] = as_sums(x[k * 500 : k * 500 + 500], y[k * 500 : k * 500 + 500])
    got = linear.nested_cv(stories, [1.0, 100.0, 1e6])
    assert len(got) == 5 and min(linear.pooled_r(got)) >= 0.95 and all(r["alpha"] < 1e6 and r["score"] > 0.9 for r in got)
    # from the definition: r of held-out stories on series, z weighted by samples, r over all folds together
    part = {k: (slice(k * 500, k * 500 + 500)) for k in stories}
    z = lambda v: v - v.mean(0)
    fit = lambda ids, alpha: np.linalg.solve(sum(z(x[part[i]]).T @ z(x[part[i]]) for i in ids) + alpha * np.eye(10), sum(z(x[part[i]]).T @ z(y[part[i]]) for i in ids))
    folds = linear.balanced_folds(list(stories), [500.0] * 10, 5)
    cross = own = actual = 0.0
    for row in got:
        train = [i for i in stories if folds[i] != row["fold"]]
        inner, best = linear.balanced_folds(train, [500.0] * len(train), 5), {}
        for alpha in (1.0, 100.0, 1e6):
            rs = []
            for j in set(inner.values()):
                w = fit([i for i in train if inner[i] != j], alpha)
                rs += [np.arctanh(np.corrcoef((x[part[i]] @ w)[:, c], y[part[i]][:, c])[0, 1]) for i in train if inner[i] == j for c in range(4)]
            best[alpha] = np.mean(rs)
        assert row["alpha"] == max(best, key=lambda v: (best[v], -v)) and row["score"] == pytest.approx(np.tanh(best[row["alpha"]]))
        w = fit(train, row["alpha"])
        for i in row["stories"]:
            p, q = z(x[part[i]]) @ w, z(y[part[i]])
            cross, own, actual = cross + (p * q).sum(0), own + (p * p).sum(0), actual + (q * q).sum(0)
    assert np.allclose(linear.pooled_r(got), cross / np.sqrt(own * actual))


def test_the_response_waveform_is_the_kernels_shape(spark):
    rng = np.random.default_rng(2)
    kernel = np.exp(-((np.arange(12) - 4) ** 2) / 4)
    rows = []
    for story in range(6):
        x = windows.padded_design(rng.normal(size=400), -2, 9)
        y = (x @ kernel)[:, None] * [1.0, 2.0] + rng.normal(size=(400, 2)) / 2
        s = as_sums(x, y)
        rows.append(("m", story, s["n"], *[s[c].ravel().tolist() for c in ("sx", "xx", "sy", "xy", "yy")]))
    sums = spark.createDataFrame(rows, "model string, story int, " + linear.SUMS)
    got = linear.response_waveform(sums, ["model"], "story", [1.0, 100.0]).orderBy("lag").collect()
    z = (kernel - kernel.mean()) / kernel.std()
    assert [r["lag"] for r in got] == list(range(12)) and np.corrcoef([r["z"] for r in got], z)[0, 1] > 0.99
    cv = linear.grouped_cv(sums, ["model"], "story", [1.0, 100.0]).collect()
    assert len(cv) == 5 and all(len(r["pooled_r"]) == 2 and min(r["pooled_r"]) > 0.9 for r in cv)


def test_folds_are_balanced():
    assert linear.balanced_folds([1, 2, 3, 4], [5, 3, 3, 1], 2) == {1: 0, 2: 1, 3: 1, 4: 0}


def test_retrieval_of_the_target_itself(spark):
    rng = np.random.default_rng(22)
    y = rng.normal(size=(160, 4))
    df = spark.createDataFrame([(1, t, v.tolist()) for t, v in enumerate(y)], "trial int, t long, y array<double>")
    got = retrieval.retrieval_windows(df.withColumn("p", F.col("y")), ["trial"], "t", "p", "y", 20, 5, 123)
    r = retrieval.summary(got, ["trial"], 5).first()
    assert (r["windows"], r["accuracy"], r["mrr"], r["chance"]) == (8, 1.0, 1.0, 0.2)
    assert rows(got, "segment") == rows(retrieval.retrieval_windows(df.repartition(5).withColumn("p", F.col("y")), ["trial"], "t", "p", "y", 20, 5, 123), "segment")
    assert retrieval.draw_candidates(3, [0, 5, 10], 5, 5, 1) == [None] * 3


def test_retrieval_by_brute_force(spark):
    r = np.random.default_rng(5)
    data = [(g, int(t) * 700 + 3, r.normal(size=3).tolist(), [0.0] * 3 if t < 4 else r.normal(size=3).tolist()) for g, k in (("a", 43), ("b", 19), (None, 25), ("c", 30)) for t in r.permutation(k)]
    df = spark.createDataFrame(data, "g string, t long, p array<double>, y array<double>")
    found = retrieval.retrieval_windows(df.repartition(4), ["g"], "t", "p", "y", 4, 5, 9)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    got = {(x["g"], x["segment"]): x for x in found.collect()}
    want = 0
    for g in ("a", "b", None, "c"):
        own = sorted((x for x in data if x[0] == g), key=lambda x: x[1])
        k = len(own) // 4
        p, y = (np.array([x[c] for x in own[: k * 4]]).reshape(k, -1) for c in (2, 3))
        for i, c in enumerate(retrieval.draw_candidates(k, [j * 4 for j in range(k)], 4, 5, [9, retrieval._number(g), 4])):
            if c is None:
                continue
            want += 1
            x = got[g, i]
            s = [0.0 if y[j].std() == 0 else np.corrcoef(p[i], y[j])[0, 1] for j in c]
            assert x["candidates"] == c and x["start"] == i * 4 and np.allclose(x["scores"], s)
            at = c.index(i)
            assert (x["positive_label"], x["predicted_label"]) == (at, int(np.argmax(s))) and x["positive_rank"] == 1 + sum(v > s[at] for v in s)
            assert abs(x["margin"] - (s[at] - np.delete(s, at).max())) < 1e-9 and abs(x["mean_negative"] - np.delete(s, at).mean()) < 1e-9 and x["correct"] == (np.argmax(s) == at)
    assert len(got) == want > 20


def test_retrieval_with_strides_and_seeds_by_trial(spark):
    r = np.random.default_rng(6)
    data = [(s, k, t, r.normal(size=2).tolist(), r.normal(size=2).tolist()) for s in (1, 2) for k in (3, 4) for t in range(61)]
    df = spark.createDataFrame(data, "subject int, trial int, t long, p array<double>, y array<double>")
    got = {(x["subject"], x["trial"], x["segment"]): x for x in retrieval.retrieval_windows(df, ["subject", "trial"], "t", "p", "y", 6, 4, 9, stride=2, width_ms=1500).collect()}
    drawn = {}
    for s in (1, 2):
        for k in (3, 4):
            starts = list(range(0, 61 - 6 + 1, 2))
            drawn[s, k] = retrieval.draw_candidates(len(starts), starts, 6, 4, [9, s, k, 1500])
            for i, c in enumerate(drawn[s, k]):
                assert got[s, k, i]["candidates"] == c and got[s, k, i]["start"] == starts[i]
    assert len({json.dumps(c) for c in drawn.values()}) == 4 and len(got) == sum(map(len, drawn.values()))
    short = retrieval.summary(retrieval.retrieval_windows(df, ["subject", "trial"], "t", "p", "y", 6, 4, 9, stride=2), ["subject", "trial"], 4).collect()
    assert all(x["binomial_p"] == pytest.approx(sum(math.comb(x["windows"], j) * 0.25**j * 0.75 ** (x["windows"] - j) for j in range(x["correct"], x["windows"] + 1)), rel=1e-9) for x in short)


def test_permutations_are_as_many_as_in_the_reference(spark):
    import __spark_entry__

    p = [r["p"] for r in __spark_entry__.queries()["permutation_correlation"](spark, "/root/testdata/sf0.001").collect() if not math.isnan(r["p"])]
    assert p and all(abs(v * 200_001 - round(v * 200_001)) < 1e-6 for v in p) and any(abs(v * 20_001 - round(v * 20_001)) > 1e-6 for v in p)


def test_ranks_and_ties(spark):
    df = spark.createDataFrame([(1, 0, 0.5, False), (1, 1, 0.5, True), (1, 2, 0.1, False)], "q int, p int, s double, pos boolean")
    r = retrieval.ranked(df, ["q"], "p", "s", "pos").first()
    assert (r["positive_rank"], r["predicted_label"], r["correct"]) == (1, 0, 0) and r["margin"] == pytest.approx(0.0) and r["mean_negative"] == pytest.approx(0.3)


def test_rasters(spark):
    df = spark.createDataFrame([(1, 1, 0.01, 0.03), (1, 2, 4.14, 4.15), (1, 3, 0.02, 0.02), (1, 4, 0.02, 0.05)], "story int, k int, start double, stop double")
    assert rows(intervals.rasterize(df, "start", "stop", 100.0, "k", ["k"], ["story"]), "frame") == [(1, 1, 1), (1, 2, 4), (1, 3, 4), (1, 4, 4), (1, 414, 2)]
    with pytest.raises(Exception, match="overlap"):
        intervals.rasterize(df, "start", "stop", 100.0, "k", ["k"], ["story"], "error").collect()


def test_frames_outside_intervals_and_single_overlaps(spark):
    frames = spark.createDataFrame([(1, i) for i in range(6)], "story int, frame long")
    out = spark.createDataFrame([(1, 0.01, 0.03), (1, 0.025, 0.04)], "story int, start double, stop double")
    assert rows(intervals.without(frames, out, "start", "stop", 100.0, ["story"]).select("frame"), "frame") == [(0,), (4,), (5,)]
    a = spark.createDataFrame([(1, 0.0, 1.0), (1, 5.0, 6.0)], "s int, a double, b double")
    b = spark.createDataFrame([(1, "x", 0.5, 2.0), (1, "y", 5.5, 9.0)], "s int, n string, c double, d double")
    assert rows(intervals.only_overlap(a, b, ["s", "a"], "a", "b", "c", "d", 3.0, ["s"]).select("a", "n"), "a") == [(0.0, "x"), (5.0, "y")]
    with pytest.raises(Exception, match="no or several"):
        intervals.only_overlap(a, b.limit(1), ["s", "a"], "a", "b", "c", "d", 3.0, ["s"]).collect()


def test_points_meet_half_open_intervals_once(spark):
    rng = np.random.default_rng(1)
    p = [(int(i), float(x)) for i, x in enumerate(rng.integers(-20, 60, 200) / 2)]
    iv = [(int(k), float(a), float(a + d)) for k, (a, d) in enumerate(zip(rng.integers(-20, 50, 40) / 2, rng.integers(0, 30, 40) / 2, strict=True))]
    a, b = spark.createDataFrame(p, "i int, x double"), spark.createDataFrame(iv, "k int, s double, e double")
    want = sorted((i, x, k, s, e) for i, x in p for k, s, e in iv if s <= x < e)
    assert sorted(rows(intervals.points_in_intervals(a, b, "x", "s", "e", 3.0).select("i", "x", "k", "s", "e"))) == want
    first = {i: min((k for j, _, k, _, _ in want if j == i), default=None) for i, _ in p}
    assert {r["i"]: r["k"] for r in intervals.first_match(a, b, ["i"], "x", "s", "e", ["k"], 3.0).collect()} == first


def test_best_pair_is_the_brute_force_one(spark):
    rng = np.random.default_rng(5)
    m = [(int(g), int(i), float(x)) for g in range(8) for i, x in enumerate(rng.integers(0, 300, rng.integers(1, 12)))]
    got = {r["g"]: (r["start"], r["stop"]) for r in intervals.best_pair(spark.createDataFrame(sorted(m, key=lambda r: (r[0], r[2])), "g int, i int, x double"), ["g"], ["x", "i"], "x", F.lit(50.0)).collect()}
    for g in range(8):
        v = [x for x, _ in sorted((x, i) for h, i, x in m if h == g)]
        pairs = [(abs(v[j] - v[i] - 50), i, j) for i in range(len(v)) for j in range(i + 1, len(v))]
        if pairs:
            assert abs(got[g][1] - got[g][0] - 50) == min(pairs)[0]
        else:
            assert g not in got


def test_best_pair_in_any_order_with_ties_and_missing_times(spark):
    rng = np.random.default_rng(6)
    m = [(g, i, None if g % 4 == 3 and rng.random() < 0.3 else float(x)) for g in range(16) for i, x in enumerate(rng.integers(0, 30, rng.integers(9, 40)))]
    m += [(None, 0, 1.0), (None, 1, 2.0), (99, 0, 1.0), (98, 0, None), (98, 1, 4.0), (98, 2, None), (97, 0, None), (97, 1, 4.0), (96, 0, 4.0), (96, 1, None), (95, 0, None), (95, 1, None)]
    lone = {98: (4.0, 4.0, None), 97: (None, 4.0, None), 96: (4.0, None, None), 95: (None, None, None)}
    for expected in (9.5, 0.0, -3.0):
        want = dict(lone)
        for g in range(16):
            v = [(i, x) for h, i, x in m if h == g and x is not None]
            e, i, j, a, b = min((abs(y - (x + expected)), i, j, x, y) for i, x in v for j, y in v if i < j)
            want[g] = (a, b, e)
        got = intervals.best_pair(spark.createDataFrame(m, "g int, i int, x double").repartition(3), ["g"], ["i"], "x", F.lit(expected)).collect()
        assert {r["g"]: (r["start"], r["stop"], r["error"]) for r in got} == want


def test_best_pair_shuffles_and_sorts_its_marks_once(spark):
    m = spark.range(100).selectExpr("id % 3 AS g", "id AS i", "cast(id AS double) AS x")
    plan = intervals.best_pair(m, ["g"], ["i"], "x", F.lit(5.0))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("+- Sort [") == 2  # each sort holds its task's marks


def test_adjacent_pairs_and_latest_marks(spark):
    m = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 10.0), ("a", 3, 200.0), ("a", 4, 500.0), ("b", 1, 0.0)], "k string, n int, at double")
    assert rows(intervals.adjacent_pairs(m, ["k"], ["n"], "at", 150)) == [("a", 200.0, 500.0, 2)]
    p = spark.createDataFrame([("a", -1.0), ("a", 10.0), ("a", 600.0)], "k string, t double")
    assert rows(intervals.latest_before(p, m, ["k"], "t", "at", ["n"]), "t") == [("a", -1.0, None), ("a", 10.0, 2), ("a", 600.0, 4)]


def test_windows(spark):
    df = spark.createDataFrame([("s", i) for i in range(10)], "k string, t int")
    assert [r["window"] for r in windows.tumbling(df, ["k"], "t", 4).collect()].count(2) == 0
    assert [r["window"] for r in windows.tumbling(df, ["k"], "t", 4, "half").collect()].count(2) == 2
    assert sorted({(r["window"], r["start"]) for r in windows.sliding(df, ["k"], "t", 4, 2).collect()}) == [(0, 0), (1, 2), (2, 4), (3, 6)]
    n = spark.createDataFrame([(100_000,), (499,)], "n long")
    assert rows(windows.chunks(n, "n", 48_000, 100, 500).select("start", "stop"), "start") == [(0, 48_100), (48_000, 96_100), (96_000, 100_000)]
    assert windows.spread_out(10, 4) == [0, 3, 6, 9] and windows.spread_out(2, 5) == [0, 1]
    assert spark.range(1).select(windows.ceil_length(F.lit(0.031), 100.0)).first()[0] == 4
    with pytest.raises(Exception, match="constant"):
        windows.column_z(df.withColumn("x", F.lit(1.0)), ["k"], "x", "z").collect()


def test_checked_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (1, "q")], "k int, w string")
    assert relational.one_to_one(a, b.limit(1), ["k"]).count() == 1
    with pytest.raises(Exception, match="repeats"):
        relational.one_to_one(a, b, ["k"]).collect()
    assert rows(relational.lookup(a.where("k = 1"), b.limit(1), "k")) == [(1, "x", "p")]
    with pytest.raises(Exception, match="not in the lexicon: 2"):
        relational.lookup(a, b.limit(1), "k").collect()
    assert rows(relational.intersection([a, b, a], ["k"])) == [(1,)]
    with pytest.raises(Exception, match="unknown id: 2"):
        relational.checked_ids(a, [1], "k").collect()
    wide = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, None)], "k int, u double, v double")
    long = relational.melted(wide, ["k"], ["u", "v"], "m", "x")
    assert relational.same_values(wide, long, ["k"], ["u", "v"], "m", "x").count() == 0
    assert rows(relational.same_values(wide, long.withColumn("x", F.col("x") + F.when(F.col("k") == 2, 1).otherwise(0)), ["k"], ["u", "v"], "m", "x")) == [(2, "u", 3.0, 4.0)]
    assert rows(relational.difference(a, b.withColumn("k", F.col("k") + 1), ["k"])) == [(1, "missing")]
    assert relational.same_set(a, a, ["k"]) and relational.set_difference(a, a).isEmpty()
    x = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>")
    assert x.select(relational.picked("x", ["A", "B", "C"], ["C", "A"])).first()[0] == [3.0, 1.0]
    with pytest.raises(ValueError, match="missing"):
        relational.picked("x", ["A"], ["Z"])


def test_names(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(names.letters_upper(F.lit(" f-p1 "))) == "FP1" and one(names.trailing_number(F.lit("sub-07"))) == 7
    assert [one(names.story_day(F.lit(k))) for k in (1, 17, 18, 33, 34, 50, 51)] == [1, 1, 2, 2, 3, 3, None]
    assert one(names.story_device(F.lit(34))) == "late" and one(names.is_auxiliary(F.lit("heog"))) is True and one(names.is_auxiliary(F.lit("x-eog"))) is False and one(names.has_auxiliary_word(F.lit("x-eog"))) is True
    assert [one(names.has_auxiliary_word(F.lit(w))) for w in ("STIM 1", "ECG", "EMG", "Fp1")] == [True, True, False, False] and one(names.folded(F.lit("Cz"))) == "cz"
    assert one(names.cjk_count(F.lit("a中文b"))) == 2 and one(names.without_ansi(F.lit("\x1b[31mred\x1b[0m"))) == "red"
    assert one(names.joined_reasons(F.lit("b;nan;a;"), names.reasons(c=F.lit(True), a=F.lit(True), d=F.lit(False)))) == "a;b;c"


def test_missing_numbers(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (None,), (math.inf,)], "x double")
    assert [r[0] for r in missing.nan_to_null(df).collect()] == [1.0, None, None, math.inf]
    assert [r[0] for r in df.select(missing.finite(F.col("x"))).collect()] == [True, False, False, False]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(missing.ratio_or_zero(F.lit(1.0), F.lit(0.0))) == 0.0 and one(missing.ratio_or_null(F.lit(1.0), F.lit(0.0))) is None
    assert one(missing.number(F.lit("x"))) is None
    with pytest.raises(Exception, match="too large"):
        missing.require(df, F.col("x") < 5, "too large").collect()


def test_p_values():
    assert st.t_survival(2.0, 10) == pytest.approx(0.036694017385, rel=1e-9)
    assert st.t_quantile(0.975, 23) == pytest.approx(2.068657610419, rel=1e-9)
    exact = sum(math.comb(20, k) for k in range(14, 21)) / 2**20
    assert st.binomial_greater(14, 20, 0.5) == pytest.approx(exact, rel=1e-12)
    assert st.sign_flip_p(np.array([1.0, 2, 3]), 0) == (2 + 1) / (8 + 1)
    assert st.sign_flip_p(np.ones(25), 1, n=2000) == pytest.approx(1 / 2001)
    assert st.permutation_p(np.arange(8.0), np.arange(8.0), 1, 2000) < 0.01 and math.isnan(st.permutation_p(np.ones(4), np.arange(4), 1, 10))


def test_p_values_of_means_and_correlations(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(st.t_two_sided(F.lit(-2.0), F.lit(10.0))) == pytest.approx(2 * 0.036694017385, rel=1e-9)
    assert one(st.pearson_p(F.lit(0.5), F.lit(12.0))) == pytest.approx(2 * st.t_survival(0.5 * math.sqrt(10 / 0.75), 10), rel=1e-9) and one(st.pearson_p(F.lit(0.5), F.lit(2.0))) is None
    assert one(st.paired_t_p(F.lit(1.0), F.lit(2.0), F.lit(16))) == pytest.approx(2 * st.t_survival(2.0, 15), rel=1e-9)
    t, df = st.welch_t(F.lit(5.0), F.lit(4.0), F.lit(8.0), F.lit(3.0), F.lit(9.0), F.lit(9.0))
    assert one(t) == pytest.approx(2 / math.sqrt(1.5)) and one(df) == pytest.approx(1.5**2 / (0.25 / 7 + 1 / 8))


def test_false_discovery(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    df = spark.createDataFrame([("a", x) for x in p] + [("b", 0.1), ("b", None)], "k string, p double")
    got = st.benjamini_hochberg(df, "p", "q", ["k"]).collect()
    assert sorted(round(r["q"], 10) for r in got if r["k"] == "a") == [0.04, round(0.16 / 3, 10), round(0.16 / 3, 10), 0.5]
    assert {r["q"] for r in got if r["k"] == "b"} == {None}


def test_robust_z_on_constant_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 2.0), ("b", 3.0)], "k string, x double")
    got = st.with_robust_z(df, "x", ["k"], "z").collect()
    assert {r["z"] for r in got if r["k"] == "a"} == {0.0} and max(r["z"] for r in got) == pytest.approx(1 / 1.4826)
    assert max(r["z"] for r in st.with_robust_z(df, "x", ["k"], "z", "clamp").collect()) > 1e9


def test_both_names_of_outlying_channels(spark):
    df = spark.createDataFrame([("s", c, v) for c, v in zip("abcde", (1.0, 1.1, 0.9, 1.05, 900.0), strict=True)], "s string, c string, std double")
    got = lambda **k: {r["c"]: r["bad_reasons"] for r in quality.channel_flags(df, ["s"], "std", 3.0, {}, **k).collect()}["e"]
    assert got() == "variance_outlier" and got(had=F.lit("flat")) == "flat;variance_outlier"


def test_array_correlation_is_pearsons(spark):
    r = np.random.default_rng(1)
    x, y = r.normal(size=(2, 9))
    df = spark.createDataFrame([(x.tolist(), y.tolist(), [1.0] * 9)], "x array<double>, y array<double>, k array<double>")
    got = df.select(retrieval.array_correlation(F.col("x"), F.col("y")), retrieval.array_correlation(F.col("x"), F.col("k"))).first()
    assert got[0] == pytest.approx(np.corrcoef(x, y)[0, 1]) and got[1] == 0.0


def test_leave_one_out_is_the_direct_correlation(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4, 30)) + rng.normal(size=30)
    df = spark.createDataFrame([("u", s, t, float(x[s, t])) for s in range(4) for t in range(30)], "unit string, s int, t int, x double")
    z = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)
    for r in retrieval.leave_one_out(df, ["unit"], "s", "t", "x").collect():
        assert r["r"] == pytest.approx(np.corrcoef(z[r["s"]], np.delete(z, r["s"], 0).mean(0))[0, 1])


def test_window_quality_of_one_loud_channel(spark):
    df = spark.createDataFrame([(0, c, float(v)) for c in "abc" for v in (10, 11, 12, 400 if c == "c" else 13)], "w int, c string, x double")
    r = quality.window_quality(df, ["w"], "c", "x", peak=300.0).first()
    assert quality.window_quality(df, ["w"], "c", "x").first()["absolute_bad"] == 0
    timed = df.groupBy("w", "c").agg(F.array_sort(F.collect_list("x")).alias("x")).select("w", "c", F.posexplode("x").alias("t", "x"))
    power = quality.window_quality(timed, ["w"], "c", "x", t="t").first()["field_power"]
    assert power == pytest.approx(np.sqrt(np.mean([0, 0, 0, np.var([1.5, 1.5, 388.5])])))
    assert r["absolute_bad"] == 1 and r["max_abs"] == pytest.approx(388.5) and r["high_fraction"] == pytest.approx(1 / 12) and r["n_samples"] == 12


def test_resampling_keeps_a_slow_wave():
    t = np.arange(500) / 100
    x = np.sin(2 * np.pi * t)
    up = signal.resample_poly(x, 5, 2)
    assert len(up) == 1250 and np.abs(up[50:-50] - np.sin(2 * np.pi * np.arange(1250) / 250)[50:-50]).max() < 2e-3
    assert np.allclose(signal.resample_fft(x, 250), x[::2], atol=1e-9) and np.allclose(signal.resample_fft(x, 500), x)
    assert signal.rational(250, 100) == (2, 5)


def test_spectra_and_filters():
    rng = np.random.default_rng(0)
    t = np.arange(4000) / 100
    f, p = signal.welch(np.sin(2 * np.pi * 10 * t) + 0.01 * rng.normal(size=4000), 100.0, 400)
    assert f[p.argmax()] == 10.0 and p.sum() * 0.25 == pytest.approx(0.5, rel=0.01)
    x = np.sin(2 * np.pi * 1 * t) + np.sin(2 * np.pi * 30 * t)
    y = signal.filtfilt(signal.butter_sos(8, 0.2), x)
    assert np.abs(y - np.sin(2 * np.pi * t))[200:-200].max() < 1e-3
    assert signal.peaks(np.array([0, 3.0, 3, 0, 5, 0, 1, 0]), 2.0, 4).tolist() == [4] and signal.peaks(np.array([0, 3.0, 3, 0, 5, 0]), 2.0, 1).tolist() == [1, 4]


def test_measures_of_spectra(spark):
    r = np.random.default_rng(3)
    f = np.arange(0, 60.5, 0.5)
    psd = {c: r.uniform(0.1, 2, len(f)) for c in "ab"}
    psd["b"][20:40] = 0.0
    df = spark.createDataFrame([(c, float(x), float(p)) for c, ps in psd.items() for x, p in zip(f, ps, strict=True)], "c string, frequency double, power double")
    for low, high in ((1.0, 40.0), (13.0, 30.0), (59.9, 60.4)):
        got = {x["c"]: x["p"] for x in signal.band_power(df, ["c"], low, high, "p").collect()}
        m = (f >= low) & (f < high)
        assert got == {c: pytest.approx(np.trapezoid(p[m], f[m])) if m.sum() > 1 else None for c, p in psd.items()}
    got = {x["c"]: x for x in df.groupBy("c").agg(signal.spectral_slope().alias("s"), signal.line_noise_db().alias("l")).collect()}
    tiny = np.finfo(float).tiny
    for c, p in psd.items():
        m = (f >= 2) & (f <= 40)
        assert got[c]["s"] == pytest.approx(np.polyfit(np.log10(f[m]), np.log10(np.maximum(p[m], tiny)), 1)[0])
        mean = lambda lo, hi: p[(f >= lo) & (f < hi)].mean()  # noqa: B023, E731
        assert got[c]["l"] == pytest.approx(10 * np.log10(mean(49, 51) / ((mean(45, 48) + mean(52, 55)) / 2)))


def test_mel():
    assert signal.log_mel(np.zeros(16_000), 100).shape == (100, 80) and (signal.log_mel(np.zeros(16_000), 100) == -9).all()
    assert [signal.frame_count(n, 48_000) for n in (48_000, 48_001, 47_999)] == [100, 101, 100]
    with pytest.raises(ValueError):
        signal.frame_count(0, 48_000)
    loud = signal.log_mel(np.sin(2 * np.pi * 1000 * np.arange(16_000) / 16_000), 100)
    assert 20 < loud[50].argmax() < 32


def test_audits(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0], [-0.0, 1.0]), (2, [1.0], [1.5]), (3, [1.0], [1.0, 2.0])], "k int, a array<double>, b array<double>")
    got = {r["k"]: (r["same_shape"], r["same_values"], r["same_bits"], r["max_abs"]) for r in audit.compare_arrays(df, "a", "b").collect()}
    assert got[1] == (True, True, False, 0.0) and got[2] == (True, False, False, 0.5) and got[3][0] is False
    assert rows(audit.checks(df, {"small": F.col("k") < 3, "all": F.col("k") > 0}), "check") == [("all", 3, 0, True), ("small", 3, 1, False)]
    a, b = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "p string, c string"), spark.createDataFrame([("x", "1"), ("y", "9")], "p string, c string")
    wild = audit.array_profile(spark.createDataFrame([(1, [0.0, 1.0, 5.0]), (2, [math.nan, 1.0])], "k int, x array<double>"), ["k"], "x").orderBy("k").collect()
    assert (wild[0]["n"], wild[0]["low"], wild[0]["high"], wild[0]["finite"], round(wild[0]["robust_sd"], 4)) == (3, 0.0, 5.0, True, 1.4826) and wild[1]["finite"] is False
    assert rows(audit.same_content(a, b, "p", "c"), "p") == [("x", "EXACT"), ("y", "DIFFERENT"), ("z", "NOT_COMPARABLE")]


def test_sources(spark, tmp_path):
    np.save(tmp_path / "f.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert [tuple(r)[1:] for r in readers.npy_frames(spark, str(tmp_path), 2.0).orderBy("t").collect()] == [(0, [0.0, 2.0]), (1, [4.0, 6.0]), (2, [8.0, 10.0])]
    assert [tuple(r)[1:] for r in readers.array_headers(spark, str(tmp_path)).collect()] == [([3, 2], "<f4")]
    np.savez(tmp_path / "e.npz", eeg_data=np.array([[1.0, 2], [3, 4], [8, 9]]), ch_names=["A", "B", "C"])
    assert [r["x"] for r in readers.npz_frames(spark, str(tmp_path), channels=["c", "a"], average_reference=True).orderBy("t").collect()] == [[3.5, -3.5], [3.5, -3.5]]
    with pytest.raises(Exception, match="missing channels"):
        readers.npz_frames(spark, str(tmp_path), channels=["Q"]).collect()
    (tmp_path / "h.vhdr").write_text("[Common Infos]\nNumberOfChannels=3\nSamplingInterval=1000\nDataFile=x.eeg\n[Binary Infos]\nBinaryFormat=IEEE_FLOAT_32\n")
    assert tuple(readers.recording_headers(spark, str(tmp_path / "h.vhdr")).first())[1:] == (3, 1000.0, "IEEE_FLOAT_32", "x.eeg")
    np.arange(12, dtype="<f4").tofile(tmp_path / "x.eeg")
    assert rows(readers.recording_chunks(spark, str(tmp_path / "x.eeg"), 3, 2, picks=[2, 0]).select("t", "x", "chunk"), "t") == [(0, [2.0, 0.0], 0), (1, [5.0, 3.0], 0), (2, [8.0, 6.0], 1), (3, [11.0, 9.0], 1)]
    np.arange(100, 109, dtype="<f4").tofile(tmp_path / "y.eeg")
    cut = readers.recording_chunks(spark, str(tmp_path), 3, 2, picks=[1], first=1, last=3, pattern="*.eeg")
    assert rows(cut.select(F.substring_index("path", "/", -1).alias("file"), "chunk", "start_sample", "t", "x"), "file", "t") == [("x.eeg", 0, 0, 1, [4.0]), ("x.eeg", 1, 2, 2, [7.0]), ("y.eeg", 0, 0, 1, [104.0]), ("y.eeg", 1, 2, 2, [107.0])]
    assert readers.recording_chunks(spark, str(tmp_path), 3, 2, first=4, pattern="*.eeg").count() == 0
    with pytest.raises(Exception, match="whole number of samples"):
        readers.recording_chunks(spark, str(tmp_path), 5, 2, pattern="*.eeg").collect()
    assert rows(readers.archive_headers(spark, str(tmp_path)).select("member", "shape", "dtype"), "member") == [("ch_names", [3], "<U1"), ("eeg_data", [3, 2], "<f8")]
    (tmp_path / "b.tsv").write_text("﻿participant_id\tsession_id\tbad_channels\nsub-01\tses-1\tF1  C3\nsub-02\tses-1\tn/a\n", encoding="utf-8")
    assert rows(readers.bad_channels(spark, str(tmp_path / "b.tsv"))) == [("sub-01", "ses-1", ["F1", "C3"]), ("sub-02", "ses-1", [])]
    for s in (3, 12):
        (tmp_path / f"sub-{s:02d}").mkdir()
        (tmp_path / f"sub-{s:02d}/m.csv").write_text("a\n1.5\n")
    assert rows(readers.subject_tables(spark, str(tmp_path), "m.csv", "a double"), "subject_number") == [(1.5, 3), (1.5, 12)]
    (tmp_path / "r.json").write_text(json.dumps({"issues": {"issues": [{"severity": "ERROR", "code": "X"}, {"severity": "error", "code": "X"}]}}))
    assert rows(readers.validator_report(spark, str(tmp_path / "r.json"))) == [("error", "X", 2)]
    (tmp_path / "o.json").write_text(json.dumps({"issues": {"errors": [{"code": "1", "key": "K"}], "warnings": []}}))
    assert rows(readers.validator_report(spark, str(tmp_path / "o.json"))) == [("error", "K", 1)]
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(Exception, match="layout"):
        readers.validator_report(spark, str(tmp_path / "bad.json")).collect()
    assert readers.checksums(spark, str(tmp_path / "h.vhdr")).count() == 1
    (tmp_path / "side.json").write_text(json.dumps({"SamplingFrequency": 500, "TaskName": "x"}))
    assert rows(readers.sidecars(spark, str(tmp_path / "side.json"), "SamplingFrequency double, TaskName string")) == [(500.0, "x")]


def test_robust_statistics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", -9.0), ("a", 2.0), ("a", float("nan")), ("a", None), (None, 3.0)], "k string, x double")
    got = quality.robust_statistics(df, ["k"], "x").select("k", "median", "mad", "max_abs")
    assert rows(got, "k") == [(None, 3.0, 0.0, 3.0), ("a", 1.0, 1.4826, 9.0)]
    assert quality.robust_statistics(df.limit(0), ["k"], "x").count() == 0


def test_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for bad in ("in", "in/x", "."):
        with pytest.raises(ValueError):
            sinks.safe_output(str(tmp_path / bad), [str(tmp_path / "in")])
    assert sinks.safe_output(str(tmp_path / "out"), [str(tmp_path / "in")]).endswith("out")
    with pytest.raises(FileExistsError):
        sinks.safe_output(str(tmp_path / "in"), [], new=True)
    assert sinks.signature({"a": 1, "b": 2}) == sinks.signature({"b": 2, "a": 1}) != sinks.signature({"a": 1})
    df = spark.createDataFrame([(1, 0.123456789), (2, None)], "k int, x double")
    sinks.write_tsv(sinks.exported(df, ["x", "k"], 4).coalesce(1), str(tmp_path / "t"))
    assert rows(readers.tsv(spark, str(tmp_path / "t"), "x double, k int"), "k") == [(0.1235, 1), (None, 2)]
    a = spark.createDataFrame([([1.0, math.nan],)], "x array<double>")
    with pytest.raises(Exception, match="finite"):
        sinks.write_arrays(a, str(tmp_path / "w"), ["x"])
    made = []
    make = lambda: made.append(1) or df
    for c in (1, 1, 2):
        assert sinks.resumed(spark, str(tmp_path / "r"), {"c": c}, make).count() == 2
    assert len(made) == 2
    with pytest.raises(ValueError):
        sinks.resumed(spark, str(tmp_path / "r"), {"c": 3}, make, "raise")


def test_a_stream_carries_the_last_sample(spark, tmp_path):
    d = str(tmp_path / "in")
    out = []
    stream = spark.readStream.schema("k string, t int, x double").option("maxFilesPerTrigger", 1).parquet(d + "*")
    for a in (0, 3):
        spark.createDataFrame([("k", a + i, float((a + i) * (a + i))) for i in range(3)], "k string, t int, x double").coalesce(1).write.mode("append").parquet(d)
        q = quality_stream.jumps_across_batches(stream, "k", "t", "x", 4.0)
        q.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).start().awaitTermination()
    assert out == [("k", 3, 0), ("k", 3, 3)]


#: Queries without SQL, and the tests that hold what they apply against numpy, brute force or the definition.
HELD = {
    "ridge_path": ["test_ridge_recovers_weights", "test_sums_do_not_depend_on_partitions", "test_a_doubled_column_shares_its_weight"],
    "ridge_predictions": ["test_ridge_recovers_weights"],
    "nested_cv": ["test_response_model_recovers_correlation"],
    "trf_correlation": ["test_cross_validation_shares_operators_and_follows_the_definition", "test_synthetic_recovery"],
    "response_waveform": ["test_the_response_waveform_is_the_kernels_shape", "test_synthetic_recovery"],
    "candidate_retrieval": ["test_retrieval_by_brute_force", "test_retrieval_with_strides_and_seeds_by_trial"],
    "retrieval_summary": ["test_retrieval_with_strides_and_seeds_by_trial"],
    "fft_resample": ["test_resampling_keeps_a_slow_wave"],
    "poly_resample": ["test_resampling_keeps_a_slow_wave"],
    "lowpass": ["test_spectra_and_filters"],
    "log_mel_frames": ["test_mel"],
    "welch_psd": ["test_spectra_and_filters"],
    "spectral_measures": ["test_measures_of_spectra"],
    "artifact_rate": ["test_spectra_and_filters"],
    "trial_splits": ["test_splits_are_whole_disjoint_and_repeatable"],
    "condition_statistics": ["test_p_values", "test_condition_statistics_from_the_rows"],
    "permutation_correlation": ["test_permutations", "test_one_list_is_dealt_to_many_tasks"],
    "sign_flip_drawn": ["test_sign_flips", "test_batches_are_dealt_to_many_tasks"],
}


def test_every_query_has_its_sql_or_a_test(spark):
    import __spark_entry__ as e
    from tidewave.plans import registry

    q, sql = e.queries(), e.oracle_sql()
    written = "".join(p.read_text() for p in Path(__file__).parent.glob("test_*.py"))
    assert set(sql) <= set(q) and "window_quality_rollup" in q
    assert set(registry.queries()) - set(sql) == set(HELD) and all(f"def {n}(" in written for held in HELD.values() for n in held)
    assert e.entry(spark).count() > 0


def test_condition_statistics_from_the_rows(spark):
    import __spark_entry__ as e

    sf = "/root/testdata/sf0.001"
    l = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_returnflag", "l_discount").toPandas()
    l["c"] = (l["l_discount"] > 0.05).astype(int)
    for r in e.queries()["condition_statistics"](spark, sf).collect():
        own = l[l["l_returnflag"] == r["l_returnflag"]]
        acc = own.groupby("l_suppkey")["c"].mean()
        sem = acc.std() / math.sqrt(len(acc))
        half = st.t_quantile(0.975, len(acc) - 1) * sem
        assert r["mean"] == pytest.approx(acc.mean()) and (r["low"], r["high"]) == pytest.approx((acc.mean() - half, acc.mean() + half))
        assert r["p_greater"] == pytest.approx(st.t_survival((acc.mean() - 0.5) / sem, len(acc) - 1)) and r["p_binomial"] == pytest.approx(st.binomial_greater(int(own["c"].sum()), len(own), 0.5))


def test_model_hooks(spark):
    from tidewave.sources import models

    files = spark.createDataFrame([("a", bytearray(np.arange(3, dtype="<f4").tobytes()))], "path string, content binary")
    assert rows(models.decoded_audio(files, lambda b: np.frombuffer(b, "<f4"), 2), "t") == [("a", 0, 0.0), ("a", 1, 1.0), ("a", 2, 2.0)]
    words = spark.createDataFrame([(1, "ab"), (1, "abcd"), (2, "a")], "w int, s string")
    got = models.pooled(models.embedded(words, lambda: lambda xs: [[len(s), 1.0] for s in xs], "s").withColumnRenamed("y", "v"), ["w"], "v")
    assert rows(got, "w") == [(1, [3.0, 1.0]), (2, [1.0, 1.0])]


def test_recordings(spark):
    from tidewave.operators import recordings

    groups = spark.createDataFrame([(1, 1, 2), (2, 3, 3)], "group_id int, first int, last int")
    trials = spark.createDataFrame([(1,), (2,), (3,)], "trial int")
    assert rows(recordings.trials_of_groups(groups, trials), "trial") == [(1, 1), (2, 1), (3, 2)]
    with pytest.raises(Exception, match="no or several"):
        recordings.trials_of_groups(groups, trials.unionByName(spark.createDataFrame([(9,)], "trial int"))).collect()
    s = spark.createDataFrame([("a", t, float(t)) for t in range(6)], "k string, t long, x double")
    e = spark.createDataFrame([("a", 0.2, 0.2)], "k string, start double, duration double")
    arrays = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "k int, x array<double>")
    assert rows(recordings.rescaled(arrays, "x", F.col("k") == 2, 10.0), "k") == [(1, [1.0, 2.0]), (2, [10.0, 20.0])]
    texts = spark.createDataFrame([("a", "TBD later"), ("b", "done")], "p string, text string")
    assert rows(recordings.placeholders(texts).select("p")) == [("a",)] and rows(recordings.redacted(texts, {"text": None}), "p") == [("a", None), ("b", None)]
    assert [r["t"] for r in recordings.segments(s, e, ["k"], "t", 10.0).orderBy("t").collect()] == [2, 3, 4]
    r = s.withColumn("rate", F.lit(100))
    assert rows(recordings.to_rate(r, ["k"], "t", "rate", 50).select("t", "x"), "t") == [(0, 0.0), (1, 2.0), (2, 4.0)]
    with pytest.raises(Exception, match="multiple"):
        recordings.to_rate(r, ["k"], "t", "rate", 30).collect()
    short = spark.createDataFrame([("a", 5, 9)], "k string, have long, need long")
    with pytest.raises(Exception, match="ends before"):
        recordings.completeness([spark.createDataFrame([("a",)], "k string")], short, ["k"], "have", "need").collect()

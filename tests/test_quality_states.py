"""Channel states against their definition, merged in any way; final reasons."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions import names
from tidewave.functions import statistics as st
from tidewave.operators import quality

NAN, INF = float("nan"), float("inf")


def recording(seed, channels=5, n=90):
    """Samples with every kind of gap, a flat run, jumps of exactly the limit and a channel of missing samples only."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(channels, n)) * 60 + rng.normal(size=n) * 80
    x[0, 10:14] = NAN
    x[1, 5], x[1, 6], x[1, 40] = INF, -INF, NAN
    x[2, 20:30] = 4.0
    x[2, 50], x[2, 51], x[2, 52] = 0.0, 80.0, 0.0
    x[3, 29], x[3, 30] = 0.0, 500.0  # a jump between chunks
    x[4] = NAN
    return x


def by_definition(x, size, jump, flat, every):
    """Chunk after chunk over arrays, as the accumulators are defined."""
    n = len(x)
    acc = {k: np.zeros(n) for k in ("finite", "nonfinite", "zeros", "total", "squares", "above_100", "above_150", "above_200", "flat", "jumps", "differences", "r_sum", "r_weight")}
    before = None
    with np.errstate(all="ignore"):
        for a in range(0, x.shape[1], size):
            v = x[:, a : a + size]
            ok = np.isfinite(v)
            clean = np.where(ok, v, 0)
            far = np.abs(v - np.nanmedian(v, axis=1, keepdims=True))
            d = np.abs(np.diff(v if before is None else np.column_stack([before, v]), axis=1))
            good = np.isfinite(d)
            some = v[:, ::every]
            ref = np.nanmedian(some, axis=0)
            ref = ref - np.nanmean(ref)
            c = some - np.nanmean(some, axis=1, keepdims=True)
            r = np.nansum(c * ref, axis=1) / (np.sqrt(np.nansum(c * c, axis=1)) * np.sqrt(np.nansum(ref * ref)))
            valid = np.isfinite(r)
            for k, add in {
                "finite": ok.sum(1), "nonfinite": (~ok).sum(1), "zeros": ((v == 0) & ok).sum(1), "total": clean.sum(1), "squares": (clean * clean).sum(1),
                "above_100": (far > 100).sum(1), "above_150": (far > 150).sum(1), "above_200": (far > 200).sum(1),
                "flat": ((d <= flat) & good).sum(1), "jumps": ((d >= jump) & good).sum(1), "differences": good.sum(1),
                "r_sum": np.where(valid, r, 0) * some.shape[1], "r_weight": valid * some.shape[1],
            }.items():
                acc[k] += add
            before = v[:, -1]
        acc["minimum"], acc["maximum"] = np.nanmin(x, axis=1), np.nanmax(x, axis=1)
    return acc


def frame(spark, x, size):
    rows = [("s", f"c{c}", t // size, t, None if math.isnan(v) and t % 2 else float(v)) for c, row in enumerate(x) for t, v in enumerate(row)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "subject string, channel string, chunk int, t int, value double")


@pytest.mark.parametrize("size,every,parts", [(30, 1, 3), (30, 4, 7), (7, 2, 5), (90, 3, 2), (1000, 1, 1)])
@pytest.mark.filterwarnings("ignore")
def test_states_are_the_definition_however_they_are_merged(spark, size, every, parts):
    x = recording(size)
    due = by_definition(x, size, 80.0, 1e-9, every)
    states = quality.chunk_states(frame(spark, x, size).repartition(parts), ["subject"], "channel", "chunk", ["t"], "value", 80.0, every=every)
    keys = ["subject", "channel"]
    at_once = quality.merged(states, keys, 80.0)
    # neighbours first: the runs before and after a place in the middle, then both
    early, late = (quality.merged(states.where(c), keys, 80.0) for c in (F.col("start.t") < 40, F.col("start.t") >= 40))
    in_steps = quality.merged(early.unionByName(late), keys, 80.0)
    for df in (at_once, in_steps):
        got = sorted(df.collect(), key=lambda r: r["channel"])
        assert len(got) == 5 and all(r["n_samples"] == 90 for r in got)
        for k, v in due.items():
            np.testing.assert_allclose([NAN if r[k] is None else r[k] for r in got], v, rtol=1e-9, atol=1e-9, err_msg=k)
    done = {r["channel"]: r for r in quality.finished(at_once).collect()}
    ok = x[0][np.isfinite(x[0])]
    assert done["c0"]["mean"] == pytest.approx(ok.mean()) and done["c0"]["std"] == pytest.approx(ok.std()) and done["c0"]["nonfinite_fraction"] == pytest.approx(4 / 90)
    assert done["c4"]["mean"] == 0.0 and done["c4"]["minimum"] is None and done["c4"]["r"] is None
    r = due["r_sum"] / np.where(due["r_weight"] > 0, due["r_weight"], np.nan)
    assert [done[f"c{i}"]["r"] is None for i in range(5)] == list(np.isnan(r)) and done["c2"]["r"] == pytest.approx(r[2])


def test_a_jump_of_exactly_the_limit_counts(spark):
    rows = [("s", "c", 0, 0, 0.0), ("s", "c", 0, 1, 80.0), ("s", "c", 1, 2, 0.0), ("s", "c", 1, 3, None), ("s", "c", 2, 4, 1.0), ("s", "c", 2, 5, 3.0)]
    df = spark.createDataFrame(rows, "subject string, channel string, chunk int, t int, value double")
    got = quality.channel_accumulators(df, ["subject"], "channel", "chunk", ["t"], "value", 80.0, every=None).first()
    assert (got["jumps"], got["differences"], got["finite"], got["nonfinite"]) == (2, 3, 5, 1)
    assert quality.finished(quality.channel_accumulators(df, ["subject"], "channel", "chunk", ["t"], "value", 80.0)).first()["mean"] == pytest.approx(84 / 5)


def test_one_odd_channel_among_equal_ones(spark):
    df = spark.createDataFrame([("s", c, v) for c, v in zip("abcde", [10.0, 10.0, 10.0, 10.0, 900.0], strict=True)] + [("s", "f", None), ("s", "g", NAN)], "s string, c string, v double")
    raw = {r["c"]: r["bad_reasons"] for r in quality.channel_flags(df, ["s"], "v", 3.0, {}).collect()}
    assert raw == {"a": "", "b": "", "c": "", "d": "", "e": "variance_outlier", "f": "", "g": ""}
    final = {r["c"]: (r["bad_reasons"], r["bad_channel"]) for r in quality.finalized_channels(df, ["s"], "v", "v", 3.0, F.lit("x;;nan")).collect()}
    assert set(final.values()) == {("x", 1)}  # final rules have no scale to compare with
    z = {r["c"]: r["z"] for r in st.with_robust_z(df, "v", ["s"], "z").collect()}
    assert set(z.values()) == {0.0}


def test_final_reasons(spark):
    rows = [("s", f"c{i}", float(i % 5), 10.0 ** (i % 4)) for i in range(40)] + [("s", "line", 60.0, 10.0), ("s", "muscle", 1.0, 1e30), ("s", "low", -60.0, 1e-30), ("s", "none", None, None)]
    df = spark.createDataFrame(rows, "s string, c string, line double, muscle double")
    got = {r["c"]: r["bad_reasons"] for r in quality.finalized_channels(df, ["s"], "line", "muscle", 5.0, F.when(F.col("c") == "line", "flat")).collect()}
    assert got["line"] == "flat;line_noise_outlier" and got["muscle"] == "muscle_power_outlier" and got["low"] == got["none"] == got["c1"] == ""


def test_sessions_and_trials(spark):
    sessions = spark.createDataFrame([("d1", f"s{i}", 1.0 + i / 10, 0.0) for i in range(8)] + [("d1", "far", 1e9, 0.6), ("d1", "lone", None, 0.0)], "day string, subject string, power double, bad_windows double")
    channels = spark.createDataFrame([("d1", f"s{i}", int(i == 2)) for i in range(8) for _ in range(2)] + [("d1", "far", 0)], "day string, subject string, bad_channel int")
    got = {r["subject"]: r for r in quality.finalized_sessions(sessions, channels, ["day", "subject"], ["day"], {"power": True}, "bad_windows", 0.5, 5.0).collect()}
    assert got["s2"]["review_reasons"] == "many_bad_channels" and got["s2"]["n_bad"] == 2 and got["far"]["review_reasons"] == "many_bad_windows;power_outlier"
    assert got["lone"]["n_channels"] is None and got["lone"]["flag_for_review"] == 0 and got["lone"]["power_z"] is None
    trials = spark.createDataFrame([("d", i, 1.0 + i % 3, 0.0, 4) for i in range(9)] + [("d", 50, 1e12, 0.3, 4), ("d", 51, 2.0, 0.31, 0)], "day string, trial int, rms double, bad double, n int")
    out = {r["trial"]: r["review_reasons"] for r in quality.finalized_trials(trials, ["day"], "rms", "bad", "n", 0.3, 5.0).collect()}
    assert out[50] == "rms_outlier;" and out[51] == "many_bad_windows;no_quality_windows;" and out[0] == ""


def test_auxiliary_names(spark):
    rows = [(" EOG",), ("E-OG",), ("e_c.g 1",), ("heo",), ("FP-EOG",), ("é EOG",), (None,)]
    got = [r["a"] for r in spark.createDataFrame(rows, "n string").select(names.is_auxiliary(F.col("n")).alias("a")).collect()]
    assert got == [True, True, True, True, False, True, None]

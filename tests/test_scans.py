"""Scans that crop, resample and normalise names; paths; summaries of paired and inter-subject measures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions import names
from tidewave.functions import statistics as st
from tidewave.operators import intervals, quality, recordings, signal, windows
from tidewave.sources import readers


def test_cropped_and_resampled_scans(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(3, 250))
    np.savez(tmp_path / "a.npz", eeg_data=x, ch_names=np.array([" Fp1 ", "C-z", "Oz"]))
    np.save(tmp_path / "b.npy", x[0])
    at = str(tmp_path)
    got = readers.npz_frames(spark, at, channels=["FP1", "oz"], normalize="stripped_upper", rates=(125, 64), first=10, last=90).orderBy("t").collect()
    due = signal.resample_poly(x.T, 64, 125)[10:90][:, [0, 2]]
    np.testing.assert_allclose([r["x"] for r in got], due, rtol=1e-6)
    assert len(readers.npz_frames(spark, at, channels=["cz"], normalize="letters_upper").collect()) == 250
    with pytest.raises(Exception, match="missing channels"):
        readers.npz_frames(spark, at, channels=["cz"]).collect()
    y = readers.npy_frames(spark, at, rates=(125, 125), first=240).orderBy("t").collect()
    np.testing.assert_allclose([r["y"][0] for r in y], x[0][240:], rtol=1e-6)


def test_paths_of_recordings(spark):
    rows = [(1, 1), (7, 33), (25, 50), (120, 18), (None, 5), (3, None), (3, 51)]
    s, k = F.col("s"), F.col("k")
    got = spark.createDataFrame(rows, "s int, k int").select(names.recording_path("/data/", s, names.story_day(k), k).alias("p"), names.recording_path("/data", s, F.lit(2)).alias("r")).collect()
    assert got[0]["p"] == "/data/sub-01/ses-day1/eeg/sub-01_ses-day1_task-audio_desc-story01_eeg.npz"
    assert got[1]["p"].endswith("ses-day2_task-audio_desc-story33_eeg.npz") and got[2]["p"].endswith("sub-25_ses-day3_task-audio_desc-story50_eeg.npz")
    assert "sub-120/" in got[3]["p"] and [got[i]["p"] for i in (4, 5, 6)] == [None] * 3
    assert got[0]["r"] == "/data/sub-01/ses-day2/eeg/sub-01_ses-day2_task-audio_desc-rest_eeg.npz"


def test_paired_summary(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=12) + 0.5, rng.normal(size=12) * 2
    rows = [("k", float(x), float(y)) for x, y in zip(a, b, strict=True)] + [("k", 9.0, None), ("flat", 1.0, 0.0), ("flat", 1.0, 0.0), ("one", 1.0, 0.5)]
    got = {r["k"]: r for r in st.paired_summary(spark.createDataFrame(rows, "k string, a double, b double"), ["k"], "a", "b").collect()}
    d = a - b
    assert got["k"]["n"] == 12 and got["k"]["dz"] == pytest.approx(d.mean() / d.std(ddof=1)) and got["k"]["t"] == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(12)))
    va, vb = a.var(ddof=1) / 12, b.var(ddof=1) / 12
    assert got["k"]["welch_t"] == pytest.approx((a.mean() - b.mean()) / math.sqrt(va + vb)) and got["k"]["welch_df"] == pytest.approx((va + vb) ** 2 / (va**2 / 11 + vb**2 / 11))
    assert got["flat"]["t"] is None and got["flat"]["welch_t"] is None and got["one"]["dz"] is None and got["one"]["n"] == 1


def test_inter_subject_summaries(spark):
    r = {(s, c): 0.1 * s + 0.2 * c for s in range(3) for c in range(2)}
    df = spark.createDataFrame([("t", f"s{s}", f"c{c}", v) for (s, c), v in r.items()], "trial string, subject string, channel string, r double")
    whole = recordings.isc_by_trial(df, ["trial"], "channel", ["r"]).first()["r"]
    per = [np.mean([r[s, c] for s in range(3)]) for c in range(2)]
    assert whole == pytest.approx(np.tanh(np.mean(np.arctanh(per))))
    own = {x["subject"]: x["r"] for x in recordings.isc_by_subject(df, ["trial"], "subject", ["r"]).collect()}
    assert own["s2"] == pytest.approx(np.tanh(np.mean(np.arctanh([r[2, 0], r[2, 1]]))))


def test_tokens_within_their_words(spark):
    words = spark.createDataFrame([("d", 0, 3, "foo"), ("d", 3, 9, "barbaz"), ("e", 5, 8, "end")], "k string, s int, e int, w string")
    tokens = spark.createDataFrame([("d", 0, 2), ("d", 2, 3), ("d", 6, 9), ("e", 5, 8)], "k string, a int, b int")
    look = lambda t: sorted(tuple(r) for r in intervals.words_of_tokens(t, words, ["k"], "a", "b", "s", "e", ["w"]).collect())
    assert look(tokens) == [("d", 0, 2, "foo"), ("d", 2, 3, "foo"), ("d", 6, 9, "barbaz"), ("e", 5, 8, "end")]
    for bad in (("d", 2, 4), ("e", 1, 2), ("none", 1, 2)):
        with pytest.raises(Exception, match="within a word"):
            look(tokens.unionByName(spark.createDataFrame([bad], "k string, a int, b int")))


@pytest.mark.parametrize("n,k", [(1, 4), (3, 4), (4, 4), (11, 4), (30, 7)])
def test_chunks_spread_out(spark, n, k):
    rows = [(s, c, i) for s in ("a", None) for c in range(n) for i in range(2)]
    got = windows.sampled_chunks(spark.createDataFrame(rows, "s string, c int, i int"), ["s"], "c", k).collect()
    due = np.linspace(0, n - 1, min(n, k)).round().astype(int).tolist()
    assert sorted((r["s"] or "", r["c"], r["i"]) for r in got) == sorted((s, c, i) for s in ("a", "") for c in set(due) for i in range(2))


def test_statuses_of_trials(spark):
    expected = spark.createDataFrame([("s", i) for i in range(6)], "subject string, trial int")
    found = spark.createDataFrame([("s", 0, 3, [3, 50]), ("s", 1, 3, [40, 3]), ("s", 2, 3, [4, 50]), ("s", 3, 3, [3]), ("s", 4, None, [3, 5]), ("s", 9, 3, [3, 5])], "subject string, trial int, names int, shape array<int>")
    got = {r["trial"]: (r["status"], r["channels"], r["samples"]) for r in quality.trial_statuses(expected, found, ["subject", "trial"], "names", "shape").collect()}
    assert got == {0: ("ok", 3, 50), 1: ("ok", 3, 40), 2: ("shape_error", None, None), 3: ("shape_error", None, None), 4: ("shape_error", None, None), 5: ("missing", None, None)}


def test_implausible_recordings(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(v)) for k, s in (("a", 1.0), ("b", 1e-9), ("c", 1e6)) for v in rng.normal(size=50) * s] + [("d", None), ("d", float("nan"))]
    got = {r["k"]: r["mad"] for r in quality.implausible(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", 0.01, 1000.0).collect()}
    assert got.keys() == {"b", "c", "d"} and got["d"] is None

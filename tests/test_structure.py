"""A structural audit on a release with each fault planted."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions.selection import cut
from tidewave.operators import structure

STEMS = ["sub-01/ses-day1/eeg/sub-01_ses-day1_task-audio", "sub-02/ses-day1/eeg/sub-02_ses-day1_task-audio"]
NPZ = "derivatives/sub-01_desc-story01_eeg.npz"
INDEX = "derivatives/annotation_index.tsv"


def release(root):
    def put(path, text):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text, encoding="utf-8")

    for stem in STEMS:
        name = stem.rpartition("/")[2]
        put(f"{stem}_eeg.vhdr", f"Header\nDataFile={name}_eeg.eeg\nMarkerFile={name}_eeg.vmrk\nNumberOfChannels=2\nSamplingInterval=10000\nBinaryFormat=IEEE_FLOAT_32\n")
        put(f"{stem}_eeg.vmrk", f"DataFile={name}_eeg.eeg\nMk1=Stimulus,S1,1,1,0\n")
        (root / f"{stem}_eeg.eeg").write_bytes(b"\0" * 8 * 1000)  # ten seconds
        put(f"{stem}_eeg.json", json.dumps({"SamplingFrequency": 100}))
        put(f"{stem}_channels.tsv", "﻿name\ttype\nFp1\tEEG\nCz\tEEG\n")
        put(f"{stem}_events.tsv", "onset\tduration\ttrial_type\tstory_id\tstim_file\r\n0.5\t4\tspeech\t1\taudio/1.mp3\r\n5\t5\trest\tn/a\tn/a\r\n")
    put("stimuli/audio/1.mp3", "x")
    np.savez(root / "x.npz", eeg_data=np.zeros((2, 5), np.float32), ch_names=np.array(["Fp1", "Cz"]))
    (root / "derivatives").mkdir(exist_ok=True)
    (root / "x.npz").rename(root / NPZ)
    np.save(root / "derivatives/1.npy", np.zeros(3))
    put(INDEX, "story_id\tenvelope_file\ttext_file\n1\tderivatives/1.npy\tn/a\n2\t\tstimuli/audio/1.mp3\n")


def edited(root, path, old, new):
    (root / path).write_text((root / path).read_text(encoding="utf-8").replace(old, new), encoding="utf-8")


FAULTS = {
    "missing": (lambda r: (r / f"{STEMS[0]}_eeg.json").unlink(), {("missing", f"{STEMS[0]}_eeg.json")}),
    "extra": (lambda r: (r / NPZ).rename(r / "derivatives/other.npz"), {("missing", NPZ), ("unexpected", "derivatives/other.npz")}),
    "link": (lambda r: edited(r, f"{STEMS[1]}_eeg.vmrk", "DataFile=", "DataFile=no-"), {("broken link", f"{STEMS[1]}_eeg.vmrk")}),
    "format": (lambda r: edited(r, f"{STEMS[0]}_eeg.vhdr", "IEEE_FLOAT_32", "FLOAT_99"), {("unknown format", f"{STEMS[0]}_eeg.vhdr")}),
    "cut": (lambda r: (r / f"{STEMS[0]}_eeg.eeg").write_bytes(b"\0" * 8001), {("incomplete sample", f"{STEMS[0]}_eeg.vhdr")}),
    "rate": (lambda r: edited(r, f"{STEMS[0]}_eeg.json", "100", "250"), {("rate", f"{STEMS[0]}_eeg.vhdr")}),
    "channels": (lambda r: edited(r, f"{STEMS[0]}_channels.tsv", "Cz\tEEG\n", ""), {("channel count", f"{STEMS[0]}_eeg.vhdr")}),
    "time": (lambda r: edited(r, f"{STEMS[0]}_eeg.vmrk", "S1,1,1,0", "S1,1,1,0,20240101120000000000"), {("recording time", f"{STEMS[0]}_eeg.vmrk")}),
    "event": (lambda r: edited(r, f"{STEMS[0]}_events.tsv", "5\t5\trest", "5\t5.5\trest"), {("event outside", f"{STEMS[0]}_events.tsv")}),
    "rests": (lambda r: edited(r, f"{STEMS[0]}_events.tsv", "rest", "pause"), {("rests", f"{STEMS[0]}_events.tsv")}),
    "stimulus": (lambda r: edited(r, f"{STEMS[1]}_events.tsv", "audio/1", "audio/9"), {("missing stimulus", f"{STEMS[1]}_events.tsv")}),
    "members": (lambda r: np.savez(r / NPZ, eeg_data=np.zeros((2, 5), np.float32), names=np.zeros(2)), {("archive members", NPZ)}),
    "objects": (lambda r: np.save(r / "derivatives/1.npy", np.array([{}], object), allow_pickle=True), {("objects", "derivatives/1.npy")}),
    "shape": (lambda r: np.savez(r / NPZ, eeg_data=np.zeros((3, 5), np.float32), ch_names=np.array(["Fp1", "Cz"])), {("archive shape", NPZ)}),
    "type": (lambda r: np.savez(r / NPZ, eeg_data=np.zeros((2, 5)), ch_names=np.array(["Fp1", "Cz"])), {("archive type", NPZ)}),
    "empty array": (lambda r: np.save(r / "derivatives/1.npy", np.zeros((0, 3))), {("array shape", "derivatives/1.npy")}),
    "broken": (lambda r: (r / NPZ).write_bytes(b"not an archive"), {("unreadable", NPZ)}),
    "json": (lambda r: (r / f"{STEMS[0]}_eeg.json").write_text("{"), {("unreadable", f"{STEMS[0]}_eeg.json"), ("rate", f"{STEMS[0]}_eeg.vhdr")}),
    "index": (lambda r: edited(r, INDEX, "derivatives/1.npy", "derivatives/7.npy"), {("missing indexed file", INDEX)}),
    "ids": (lambda r: edited(r, INDEX, "2\t\t", "3\t\t"), {("index ids", INDEX)}),
}

#: Faults that don't touch the same files, planted together.
GROUPS = {
    "none": [], "first": ["extra", "link", "channels", "time", "event", "stimulus", "empty array", "ids"], "second": ["missing", "cut", "rests", "members", "index"],
    "third": ["format", "shape", "rate"], "fourth": ["type", "json", "objects"], "fi%20f th": ["broken"],
}


@pytest.fixture(scope="module")
def trees(spark, tmp_path_factory):
    """All faulty releases in one tree, a folder each, so that one scan reads them."""
    root = tmp_path_factory.mktemp("releases")
    assert sorted(f for fs in GROUPS.values() for f in fs) == sorted(FAULTS)
    for name, faults in GROUPS.items():
        (root / name).mkdir()
        release(root / name)
        for f in faults:
            FAULTS[f][0](root / name)
    return cut(structure.file_tree(spark, str(root)), "tree")


@pytest.mark.parametrize("name", GROUPS)
def test_each_fault_and_no_other(spark, trees, name):
    own = trees.where(F.col("path").startswith(f"{name}/")).withColumn("path", F.expr(f"substring(path, {len(name) + 2})"))
    files = [f"{s}_{e}" for s in STEMS for e in ("eeg.vhdr", "eeg.vmrk", "eeg.eeg", "eeg.json", "channels.tsv", "events.tsv")] + [NPZ]
    expected = spark.createDataFrame([(f,) for f in files], "path string")
    found = structure.audit(own, expected, F.col("path").endswith(".npz"), [INDEX], "story_id", [1, 2]).collect()
    due = sorted(x for f in GROUPS[name] for x in FAULTS[f][1])
    assert sorted((r["rule"], r["path"]) for r in found) == due


def test_counts_and_headers(spark, trees):
    own = trees.where(F.col("path").startswith("none/"))
    counts = {(r["folder"], r["kind"]): r["files"] for r in structure.kind_counts(own).collect()}
    assert counts["none/derivatives/", ".npz"] == 1 and counts[f"none/{STEMS[0].rpartition('/')[0]}/", ".tsv"] == 2
    h = structure.headers(own).first()
    assert (h["channels"], h["rate"], h["width"]) == (2, 100.0, 4)
    z = own.where("kind = '.npz'").first()["arrays"]
    assert z["eeg_data"]["shape"] == [2, 5] and z["eeg_data"]["dtype"] == "float32"

"""The recordings data source: rows, pushed conditions, and the bytes that are read."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from tidewave.sources import recording_source as source

NAMES = ["Fp1", "Cz", "VEO", "O\\12"]


def written(folder, name, x, kind="IEEE_FLOAT_32", layout="MULTIPLEXED", resolutions=(1, 1, 0.5, 2)):
    """x is [sample, channel], as stored."""
    lines = ["Brain Vision Data Exchange Header File Version 1.0", "[Common Infos]", f"DataFile={name}.eeg", "DataFormat=BINARY", f"DataOrientation={layout}", f"NumberOfChannels={x.shape[1]}", "SamplingInterval=1000", "[Binary Infos]", f"BinaryFormat={kind}", "[Channel Infos]"]
    lines += [f"Ch{i + 1}={c},,{r},µV" for i, (c, r) in enumerate(zip(NAMES, resolutions, strict=True))] + ["[Coordinates]", "Ch1=1,-90,-72"]
    (folder / f"{name}.vhdr").write_text("\n".join(lines), encoding="utf-8")
    (x if layout == "MULTIPLEXED" else x.T).astype(source.FORMATS[kind]).tofile(folder / f"{name}.eeg")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("bi ds")
    (at / "sub-1").mkdir()
    rng = np.random.default_rng(1)
    data = {"a": rng.integers(-99, 99, (1000, 4)), "b": rng.integers(-99, 99, (300, 4)), "c": rng.integers(-99, 99, (5, 4))}
    written(at / "sub-1", "a", data["a"])
    written(at, "b", data["b"], "INT_16", "VECTORIZED")
    written(at, "c", data["c"], "INT_32")
    return at, data


def test_rows(spark, folder):
    at, data = folder
    source.register(spark)
    df = spark.read.format("recordings").option("bytes", "1000").load(str(at))
    got = df.withColumn("name", F.regexp_extract("path", r"(\w+)\.vhdr$", 1)).toPandas()
    assert len(got) == sum(x.size for x in data.values())
    for k, x in data.items():
        own = got[got["name"] == k].pivot(index="t", columns="channel", values="value")[["Fp1", "Cz", "VEO", "O,2"]]
        np.testing.assert_array_equal(own.to_numpy(), x * np.array([1, 1, 0.5, 2]))


def test_conditions_reach_the_reader(spark, folder):
    at, data = folder
    source.register(spark)
    df = spark.read.format("recordings").option("bytes", "1600").load(str(at))
    some = df.where("channel IN ('Cz', 'VEO') AND t >= 200 AND t < 250 AND t <> 210")
    got = some.collect()
    assert {(r["channel"], r["t"]) for r in got} == {(c, t) for c in ("Cz", "VEO") for t in range(200, 250) if t != 210} and len(got) == 2 * 2 * 49
    assert some.rdd.getNumPartitions() == 2  # one slice of each file that is long enough
    assert df.where("t = 999").count() == 4 and df.where("channel = 'nobody'").count() == 0 and df.where("t > 5000").count() == 0
    path = str(at / "c.vhdr")
    assert df.where(F.col("path") == path).count() == 20 and spark.read.format("recordings").load(path).count() == 20
    assert df.where("t IN (3, 990)").count() == 3 * 4 + 4 and df.where("t IN (3, 990) AND channel = 'Cz' AND channel IN ('Cz', 'Fp1')").count() == 4


def counted(reader, monkeypatch):
    """Bytes of data files that a reader takes."""
    from pyarrow import fs

    seen = []

    class File:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def read_at(self, n, at):
            seen.append((at, n))
            return self.f.read_at(n, at)

    class System:
        def __init__(self, system):
            self.system = system

        def open_input_file(self, path):
            return File(self.system.open_input_file(path))

    slices = reader.partitions()
    real = fs.FileSystem.from_uri
    rows = 0

    class Patched:
        @staticmethod
        def from_uri(uri):
            system, path = real(uri)
            return System(system), path

    monkeypatch.setattr(fs, "FileSystem", Patched)
    for s in slices:
        rows += sum(b.num_rows for b in reader.read(s))
    monkeypatch.undo()
    return rows, seen


def test_only_those_bytes_are_read(folder, monkeypatch):
    at, _ = folder
    reader = source.RecordingReader({"path": str(at / "sub-1")})
    left = list(reader.pushFilters([EqualTo(("channel",), "Cz"), GreaterThanOrEqual(("t",), 100), LessThan(("t",), 164)]))
    rows, seen = counted(reader, monkeypatch)
    assert left == [] and rows == 64 and seen == [(100 * 16, 64 * 16)]  # a range of samples, all four channels of 4 bytes
    reader = source.RecordingReader({"path": str(at / "b.vhdr")})
    left = list(reader.pushFilters([In(("channel",), ("VEO", "Cz")), In(("t",), (10, 19))]))
    rows, seen = counted(reader, monkeypatch)
    assert [type(f) for f in left] == [In] and rows == 20 and seen == [((300 + 10) * 2, 20), ((600 + 10) * 2, 20)]  # each channel's own bytes


@pytest.mark.parametrize("fault", ["cut", "no data", "format", "twice"])
def test_faulty_recordings_are_errors(tmp_path, fault):
    written(tmp_path, "a", np.zeros((10, 4)))
    header = tmp_path / "a.vhdr"
    if fault == "cut":
        (tmp_path / "a.eeg").write_bytes(b"\0" * 159)
    elif fault == "no data":
        header.write_text(header.read_text().replace("a.eeg", "b.eeg"))
    elif fault == "format":
        header.write_text(header.read_text().replace("IEEE_FLOAT_32", "ASCII"))
    else:
        header.write_text(header.read_text().replace("Cz", "fp1"))
    with pytest.raises((ValueError, FileNotFoundError)):
        source.RecordingReader({"path": str(tmp_path)}).partitions()


def test_a_folder_without_recordings_is_an_empty_table(spark, tmp_path):
    source.register(spark)
    assert spark.read.format("recordings").load(str(tmp_path)).count() == 0

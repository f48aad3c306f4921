"""Readers of recordings, features and tables.

Files come in through Spark's own readers, so any store that Spark reads will do; blocks of long recordings and headers within
archives are read in place by pyarrow's file systems at the URIs that Spark lists.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.names import NORMALIZERS
from ..operators.signal import resample_poly


def tsv(spark: SparkSession, path: str, schema: StructType | str, separator: str = "\t") -> DataFrame:
    """A table with a header; n/a is missing, a byte order mark before the header is harmless, .gz is read as it is."""
    return spark.read.schema(schema).csv(path, sep=separator, header=True, nullValue="n/a", enforceSchema=True, encoding="UTF-8")


def subject_tables(spark: SparkSession, root: str, file: str, schema: StructType | str, separator: str = ",") -> DataFrame:
    """root/sub-*/file, stacked, with the folder's number as subject_number."""
    df = tsv(spark, f"{root}/sub-*/{file}", schema, separator)
    return df.withColumn("subject_number", F.regexp_extract(F.col("_metadata.file_path"), r"/sub-(\d+)/", 1).try_cast("int"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def sidecars(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of every file."""
    return files(spark, path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def _fitted(x: np.ndarray, rates: tuple[int, int] | None, first: int, last: int | None) -> np.ndarray:
    """A file's samples [time, ...], brought from the first rate to the second, then cropped."""
    if rates is not None and rates[0] != rates[1]:
        x = resample_poly(x, rates[1], rates[0])
    return x[first:last]


def npy_frames(spark: SparkSession, path: str, scale: float = 1.0, rates: tuple[int, int] | None = None, first: int = 0, last: int | None = None) -> DataFrame:
    """path, t, y of NumPy arrays [time] or [time, dimension]; values that aren't finite fail the job. rates: the file's sampling rate and the one wanted; first and last crop what that gives, and t counts from the crop."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                yield from _frames(p, _fitted(np.load(io.BytesIO(c), allow_pickle=False).astype(np.float64), rates, first, last), scale)

    return files(spark, path, "*.npy").select("path", "content").mapInPandas(read, "path string, t long, y array<float>")


def npz_frames(spark: SparkSession, path: str, data: str = "eeg_data", names: str = "ch_names", channels: list[str] | None = None, scale: float = 1.0, average_reference: bool = False, normalize: str = "folded", rates: tuple[int, int] | None = None, first: int = 0, last: int | None = None) -> DataFrame:
    """path, t, x of NPZ recordings [channel, time] with channel names; channels are picked in the order given, with names made alike by names.NORMALIZERS[normalize]. rates, first and last are npy_frames's."""
    alike = NORMALIZERS[normalize]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(io.BytesIO(c), allow_pickle=False) as z:
                    x, have = z[data], [alike(str(n)) for n in z[names]]
                if len(set(have)) != len(have):
                    raise ValueError(f"{p}: a channel name repeats")
                if x.shape[0] != len(have):
                    x = x.T
                if channels is not None:
                    if gone := [n for n in channels if alike(n) not in have]:
                        raise ValueError(f"{p}: missing channels {gone}")
                    x = x[[have.index(alike(n)) for n in channels]]
                x = _fitted(x.T.astype(np.float64), rates, first, last)
                if average_reference:
                    x = x - x.mean(1, keepdims=True)
                yield from _frames(p, x, scale)

    return files(spark, path, "*.npz").select("path", "content").mapInPandas(read, "path string, t long, y array<float>").withColumnRenamed("y", "x")


def _frames(path: str, y: np.ndarray, scale: float, batch: int = 4096) -> Iterator[pd.DataFrame]:
    y = y[:, None] if y.ndim == 1 else y
    if not np.isfinite(y).all():
        raise ValueError(f"{path}: values that aren't finite")
    for a in range(0, len(y), batch):
        part = (y[a : a + batch] * scale).astype(np.float32)
        yield pd.DataFrame({"path": path, "t": np.arange(a, a + len(part)), "y": list(part)})


def array_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, shape and dtype of .npy files; only headers are read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                with _opened(p) as f:
                    version = np.lib.format.read_magic(f)
                    shape, _, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
                rows.append((p, list(shape), dtype.str))
            yield pd.DataFrame(rows, columns=["path", "shape", "dtype"])

    return files(spark, path, "*.npy").select("path").mapInPandas(read, "path string, shape array<int>, dtype string")


def located(path: str):
    """The file system and the place in it of a path as Spark has it: a URI or a local path, spaces and percent signs as they are."""
    from pyarrow import fs

    uri = path if re.match(r"[A-Za-z][\w+.-]*:/", path) else f"file://{path}"
    return fs.FileSystem.from_uri(quote(uri, safe=":/@[]"))


def _opened(path: str):
    """The file at a path as Spark lists it, for reads at any place."""
    system, at = located(path)
    return system.open_input_file(at)


def archive_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, member, shape and dtype of the arrays in .npz files; only directories and headers are read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                with _opened(p) as f, zipfile.ZipFile(f) as z:
                    for name in z.namelist():
                        with z.open(name) as m:
                            version = np.lib.format.read_magic(m)
                            shape, _, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(m)
                        rows.append((p, name.removesuffix(".npy"), list(shape), dtype.str))
            yield pd.DataFrame(rows, columns=["path", "member", "shape", "dtype"])

    return files(spark, path, "*.npz").select("path").mapInPandas(read, "path string, member string, shape array<int>, dtype string")


def recording_headers(spark: SparkSession, path: str) -> DataFrame:
    """Channels, sampling interval (microseconds), format and data file of text headers (.vhdr)."""
    get = lambda key: F.regexp_extract("text", rf"(?mi)^{key}\s*=\s*(.+?)\s*$", 1)
    return texts(spark, path).select("path", get("NumberOfChannels").try_cast("int").alias("n_channels"), get("SamplingInterval").try_cast("double").alias("interval_us"), get("BinaryFormat").alias("format"), get("DataFile").alias("data_file"))


def recording_chunks(spark: SparkSession, path: str, n_channels: int, samples: int, kind: str = "<f4", picks: list[int] | None = None, first: int = 0, last: int | None = None, pattern: str = "*") -> DataFrame:
    """Multiplexed binary recordings in blocks of so many samples: path, chunk, start_sample, t, x (picked channels of one sample).

    first, last: the samples [first, last) of each recording, all by default; blocks outside it aren't read. chunk, start_sample and
    t count from the recording's own start. Blocks are dealt to tasks one by one, so a long recording is read by many. A recording
    that doesn't end with a whole sample fails the job.
    """
    width = n_channels * np.dtype(kind).itemsize
    picked = picks if picks is not None else list(range(n_channels))
    whole = F.when(F.col("length") % width == 0, F.col("length").cast("long") / width).otherwise(F.raise_error(F.concat("path", F.lit(": not a whole number of samples"))).cast("double")).cast("long")
    n = whole if last is None else F.least(whole, F.lit(last))
    lengths = files(spark, path, pattern).select("path", n.alias("n")).where(F.col("n") > first)
    blocks = lengths.select("path", "n", F.explode(F.sequence(F.lit(first // samples).cast("long"), F.floor((F.col("n") - 1) / samples))).alias("chunk"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, n, chunk in pdf[["path", "n", "chunk"]].itertuples(index=False):
                a, b = max(first, chunk * samples), min(n, (chunk + 1) * samples)
                with _opened(p) as f:
                    x = np.frombuffer(f.read_at((b - a) * width, a * width), kind).reshape(b - a, n_channels)[:, picked]
                yield pd.DataFrame({"path": p, "chunk": chunk, "start_sample": chunk * samples, "t": np.arange(a, b), "x": list(x.astype(np.float32))})

    return blocks.repartition("path", "chunk").mapInPandas(read, "path string, chunk long, start_sample long, t long, x array<float>")


def validator_report(spark: SparkSession, path: str) -> DataFrame:
    """Issues of a validator's JSON report in either of its layouts: severity, code, n. A report without issues lists fails."""
    df = spark.read.schema("issues struct<errors:array<struct<code:string,key:string>>,warnings:array<struct<code:string,key:string>>,issues:array<struct<severity:string,code:string>>>").json(path, multiLine=True)
    df = df.where(F.when(F.col("issues.issues").isNotNull() | F.col("issues.errors").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("unknown report layout")).cast("boolean")))
    new = F.transform(F.coalesce("issues.issues", F.expr("cast(array() as array<struct<severity:string,code:string>>)")), lambda x: F.struct(F.lower(x["severity"]).alias("severity"), x["code"].alias("code")))
    old = lambda c, s: F.transform(F.coalesce(f"issues.{c}", F.expr("cast(array() as array<struct<code:string,key:string>>)")), lambda x: F.struct(F.lit(s).alias("severity"), F.coalesce(x["key"], x["code"]).alias("code")))
    each = df.select(F.explode(F.concat(new, old("errors", "error"), old("warnings", "warning"))).alias("i"))
    return each.groupBy("i.severity", "i.code").agg(F.count(F.lit(1)).alias("n"))


def bad_channels(spark: SparkSession, path: str) -> DataFrame:
    """participant_id, session_id, bad: the space-separated lists as arrays, empty for n/a."""
    df = tsv(spark, path, "participant_id string, session_id string, bad_channels string")
    bad = F.filter(F.split(F.trim(F.coalesce("bad_channels", F.lit(""))), " +"), lambda x: x != "")
    return df.select("participant_id", "session_id", bad.alias("bad"))

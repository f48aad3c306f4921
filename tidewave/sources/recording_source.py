"""Recordings with a text header (.vhdr) as a Spark data source: a table of path, channel, t, value that reads the bytes it is asked for.

    register(spark)
    spark.read.format("recordings").load("hdfs://.../bids").where("channel IN ('Fp1', 'Cz') AND t BETWEEN 5000 AND 9999")

Conditions on path, channel and t reach the reader when spark.sql.python.filterPushdown.enabled is true (register sets it): files, byte ranges and
channels outside them are never read. Of multiplexed files (all channels of a sample side by side) that is the range of
samples; of vectorized ones (channel after channel) each channel's own range. Every range of `bytes` bytes is a task. Values are in the header's unit, stored
numbers times the channel's resolution. Listing, and headers of a few kilobytes, are the driver's part, sixteen at a time.

Options: path; pattern of header names ("*.vhdr"); bytes a task (32 MiB).
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from .readers import located

SCHEMA = "path string, channel string, t long, value double"
#: The formats that headers name.
FORMATS = {"IEEE_FLOAT_32": "<f4", "INT_16": "<i2", "INT_32": "<i4", "UINT_16": "<u2"}
#: Samples of one channel in a batch of rows.
ROWS = 1 << 16


@dataclass
class Header:
    """What a header says, and how many samples its data file holds."""

    data_file: str
    kind: str
    multiplexed: bool
    channels: list[tuple[str, float]]  # name, resolution
    samples: int = 0
    path: str = ""
    wanted: list[int] = field(default_factory=list)


def parsed_header(text: str) -> Header:
    """A header's text; formats and layouts that aren't known are errors."""
    get = lambda key: (m := re.search(rf"(?mi)^{key}\s*=\s*(.+?)\s*$", text)) and m[1]
    kind, layout, n = FORMATS.get((get("BinaryFormat") or "").upper()), (get("DataOrientation") or "MULTIPLEXED").upper(), get("NumberOfChannels")
    if (get("DataFormat") or "BINARY").upper() != "BINARY" or kind is None or layout not in ("MULTIPLEXED", "VECTORIZED") or not n or not get("DataFile"):
        raise ValueError("a header without a known data file, format, orientation or number of channels")
    found = {int(m[1]): m[2].split(",") for m in re.finditer(r"(?mi)^Ch(\d+)\s*=\s*(.*?)\s*$", text.partition("[Coordinates]")[0])}
    channels = []
    for i in range(1, int(n) + 1):
        parts = [*found.get(i, [f"Ch{i}"]), "", "", ""]
        channels.append((parts[0].replace("\\1", ","), float(parts[2]) if parts[2].strip() else 1.0))
    if len({c.casefold() for c, _ in channels}) != len(channels):
        raise ValueError("a channel name repeats")
    return Header(get("DataFile"), kind, layout == "MULTIPLEXED", channels)


@dataclass
class Slice(InputPartition):
    header: Header
    first: int
    stop: int


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.pattern, self.bytes = options["path"], options.get("pattern", "*.vhdr"), int(options.get("bytes", 32 << 20))
        self.first, self.stop = 0, None
        self.channels: set[str] | None = None
        self.paths: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if not self._taken(f):
                yield f

    def _taken(self, f: Filter) -> bool:
        """Narrow what is read; whether Spark needn't check the condition again."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if isinstance(f, IsNotNull):
            return True  # no column is ever null
        if name in ("channel", "path") and isinstance(f, EqualTo | In):
            some = {f.value} if isinstance(f, EqualTo) else set(f.value)
            had = self.channels if name == "channel" else self.paths
            some = some if had is None else had & some
            self.channels, self.paths = (some, self.paths) if name == "channel" else (self.channels, some)
            return True
        if name != "t" or not isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
            return False
        values = [v for v in f.value if v is not None] if isinstance(f, In) else [f.value]
        low = {EqualTo: 0, In: 0, GreaterThanOrEqual: 0, GreaterThan: 1}.get(type(f))
        high = {EqualTo: 1, In: 1, LessThanOrEqual: 1, LessThan: 0}.get(type(f))
        if low is not None:
            self.first = max(self.first, min(values, default=0) + low)
        if high is not None:
            self.stop = min(max(values, default=-1) + high, self.stop if self.stop is not None else 1 << 62)
        return not isinstance(f, In)  # the range of a list has other samples between

    def _files(self) -> tuple[object, list[str], dict[str, int]]:
        from pyarrow import fs

        system, root = located(self.root)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        if info.type == fs.FileType.File:
            found += [x for x in system.get_file_info(fs.FileSelector(root.rpartition("/")[0])) if x.path != root]
        headers = sorted(x.path for x in found if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, self.pattern) and (info.type != fs.FileType.File or x.path == root))
        return system, [p for p in headers if self.paths is None or p in self.paths], {x.path: x.size for x in found if x.type == fs.FileType.File}

    def partitions(self) -> list[Slice]:
        system, headers, sizes = self._files()

        def read(path: str) -> Header:
            with system.open_input_file(path) as f:
                h = parsed_header(f.read().decode("utf-8-sig", errors="replace"))
            h.path, h.data_file = path, f"{path.rpartition('/')[0]}/{h.data_file}"
            width = len(h.channels) * np.dtype(h.kind).itemsize
            if h.data_file not in sizes:
                raise FileNotFoundError(f"{path}: no {h.data_file}")
            if sizes[h.data_file] % width:
                raise ValueError(f"{h.data_file}: not a whole number of samples")
            h.samples = sizes[h.data_file] // width
            h.wanted = [i for i, (c, _) in enumerate(h.channels) if self.channels is None or c in self.channels]
            return h

        out = []
        with ThreadPoolExecutor(16) as pool:
            for h in pool.map(read, headers):
                stop = h.samples if self.stop is None else min(self.stop, h.samples)
                step = max(1, self.bytes // (np.dtype(h.kind).itemsize * (len(h.channels) if h.multiplexed else max(1, len(h.wanted)))))
                if h.wanted:
                    out += [Slice(h, a, min(a + step, stop)) for a in range(self.first, stop, step)]
        return out or [Slice(Header("", "<f4", True, []), 0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        h, size = partition.header, np.dtype(partition.header.kind).itemsize
        if not h.wanted:
            return
        system, _ = located(self.root)
        with system.open_input_file(h.data_file) as f:
            for a in range(partition.first, partition.stop, ROWS):
                n = min(ROWS, partition.stop - a)
                if h.multiplexed:
                    block = np.frombuffer(f.read_at(n * size * len(h.channels), a * size * len(h.channels)), h.kind).reshape(n, -1)
                for i in h.wanted:
                    x = block[:, i] if h.multiplexed else np.frombuffer(f.read_at(n * size, (i * h.samples + a) * size), h.kind)
                    name, resolution = h.channels[i]
                    yield pa.RecordBatch.from_arrays([pa.repeat(h.path, n), pa.repeat(name, n), pa.array(np.arange(a, a + n)), pa.array(x.astype(np.float64) * resolution)], ["path", "channel", "t", "value"])


class RecordingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make format("recordings") known to this session, with conditions pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordingSource)

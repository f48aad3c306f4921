"""Token files of independent zstandard frames (operator 4).

A file holds, in document order: data frames, each the concatenated ids of some whole documents (little
endian); one skippable frame with the document index (per frame: its ids as JSON and its lengths); and
the seek table of the public "zstd seekable format" - per frame the compressed and the plain size and a
checksum - whose fixed footer is the file's end. A plain zstd reader can decompress such a file; a
reader that wants some documents reads the footer, the index and only their frames.

Files are written by tasks that each hold one range of ids, to a name of their own that is moved in
place at the end, so that a task run twice leaves one whole file. File systems are reached through
pyarrow.fs by the folder's URI.

Defined cases: null text is the empty text, which is the end id alone; null ids come first; rows equal
in id are ordered by text; very long texts are one document in a frame of their own; an empty table writes no file and reads as no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, work_path
from .tokens import encoder

SKIPPABLE_SEEK, SKIPPABLE_INDEX, SEEK_MAGIC = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1  # fixed values of the public format
FRAME_BYTES = 1 << 20
KINDS = {2: "<u2", 4: "<u4"}


def _open_fs(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return system, path


def _checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Writes one file to an open binary stream."""

    def __init__(self, out, width: int = 2, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.out, self.width, self.limit = out, width, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[list, list[int]]] = []
        self.size, self.parts, self.ids = 0, [], []
        self.n_tokens = self.n_docs = 0

    def add(self, doc, ids: bytes) -> None:
        if self.parts and self.size + len(ids) > self.limit:
            self._flush()
        self.parts.append(ids)
        self.ids.append(doc)
        self.size += len(ids)
        self.n_tokens += len(ids) // self.width
        self.n_docs += 1

    def _flush(self) -> None:
        data = b"".join(self.parts)
        packed = self.zstd.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), _checksum(data)))
        self.index.append((self.ids, [len(p) // self.width for p in self.parts]))
        self.size, self.parts, self.ids = 0, [], []

    def close(self) -> None:
        if self.parts:
            self._flush()
        index = self.zstd.compress(json.dumps({"width": self.width, "frames": self.index}).encode())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = [*self.frames, (8 + len(index), 0, 0)]
        body = b"".join(struct.pack("<III", *x) for x in table) + struct.pack("<IBI", len(table), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(body)) + body)


class Reader:
    """Reads documents from one seekable file-like object; only the frames asked for are decompressed."""

    def __init__(self, f):
        import zstandard

        self.f, self.zstd = f, zstandard.ZstdDecompressor()
        f.seek(0, 2)
        end = f.tell()
        f.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("not a token file")
        f.seek(end - 9 - 12 * n)
        raw = f.read(12 * n)
        table = [struct.unpack_from("<III", raw, 12 * i) for i in range(n)]
        *self.frames, (index_size, _, _) = table
        self.at = np.concatenate([[0], np.cumsum([x[0] for x in self.frames], dtype=np.int64)]).tolist()
        f.seek(self.at[-1])
        index = json.loads(self.zstd.decompress(f.read(index_size)[8:]))
        self.width, self.index = index["width"], index["frames"]

    def frame(self, k: int) -> bytes:
        packed, plain, check = self.frames[k]
        self.f.seek(self.at[k])
        data = self.zstd.decompress(self.f.read(packed), max_output_size=max(plain, 1))
        if len(data) != plain or _checksum(data) != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def documents(self, wanted: set | None = None) -> Iterator[tuple[object, np.ndarray]]:
        for k, (ids, lengths) in enumerate(self.index):
            if wanted is not None and wanted.isdisjoint(ids):
                continue
            data, at = self.frame(k), 0
            for doc, n in zip(ids, lengths, strict=True):
                if wanted is None or doc in wanted:
                    yield doc, np.frombuffer(data, KINDS[self.width], n, at)
                at += n * self.width


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, width: int = 2, id_col: str = "doc_id", text_col: str = "text", files: int | None = None, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write docs in ascending id order; returns the files as rows: file, part, n_docs, n_tokens, in the order of ids by part."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")).repartitionByRange(files or partitions(docs.sparkSession), "id").sortWithinPartitions("id", "t")
    end = np.array([end_id], dtype=KINDS[width]).tobytes()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get()
        enc, system, writer = encoder(tokenizer_path, KINDS[width]), None, None
        for pdf in batches:
            if not len(pdf):
                continue
            if writer is None:
                system, path = _open_fs(folder)
                system.create_dir(path, recursive=True)
                name = f"tokens-{task.partitionId():06d}.zst"
                own = f"{path}/.{name}.{task.taskAttemptId()}"
                out = system.open_output_stream(own)
                writer = Writer(out, width, frame_bytes)
            ids = [None if pd.isna(x) else x if isinstance(x, str) else int(x) for x in pdf["id"]]
            for doc, b in zip(ids, enc.encode(pdf["t"]), strict=True):
                writer.add(doc, b + end)
        if writer:
            writer.close()
            out.close()
            system.move(own, f"{path}/{name}")
            yield pd.DataFrame([(f"{folder}/{name}", task.partitionId(), writer.n_docs, writer.n_tokens)], columns=["file", "part", "n_docs", "n_tokens"])

    return rows.mapInPandas(write, "file string, part int, n_docs long, n_tokens long")


def read_tokens(files: DataFrame, id_type: str = "long", with_ids: bool = False) -> DataFrame:
    """Every document of the files (columns file, base: the tokens before the file): id, start, n_tokens, ids_crc32 (ids as unsigned 32-bit) and, if asked for, ids."""
    schema = f"id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, base in zip(pdf["file"], pdf["base"], strict=True):
                system, path = _open_fs(file)
                with system.open_input_file(path) as f:
                    yield from _frames(_located(Reader(f).documents(), int(base)), with_ids, id_type)

    return files.select("file", "base").repartition(max(1, files.count()), "file").mapInPandas(read, schema)


def _located(docs: Iterable, at: int) -> Iterator[tuple]:
    for doc, ids in docs:
        yield doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids
        at += len(ids)


def _frames(rows: Iterable[tuple], with_ids: bool, id_type: str) -> Iterator[pd.DataFrame]:
    names, got = ["id", "start", "n_tokens", "ids_crc32"], []

    def frame() -> pd.DataFrame:
        out = pd.DataFrame([g[:4] for g in got], columns=names)
        if id_type != "string":
            out["id"] = pd.array(out["id"], dtype="Int64")
        return out.assign(ids=[g[4].astype(np.int32) for g in got]) if with_ids else out

    for r in rows:
        got.append(r)
        if len(got) >= 2000:
            yield frame()
            got = []
    if got:
        yield frame()


def with_bases(spark: SparkSession, files: DataFrame) -> DataFrame:
    """files with base, the number of tokens in files of lower ranges, which is read from the files' own indexes. One row a file reaches the driver."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, part in zip(pdf["file"], pdf["part"], strict=True):
                system, path = _open_fs(file)
                with system.open_input_file(path) as f:
                    rows.append((file, part, sum(sum(lengths) for _, lengths in Reader(f).index)))
            yield pd.DataFrame(rows, columns=["file", "part", "n_tokens"])

    base, out = 0, []
    for r in sorted(files.select("file", "part").mapInPandas(counted, "file string, part int, n_tokens long").collect(), key=lambda r: r["part"]):
        out.append((r["file"], base))
        base += r["n_tokens"]
    return spark.createDataFrame(out, "file string, base long")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 0, width: int = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write docs as token files in folder (by default a new one in the shared folder) and read every document back."""
    folder = folder or work_path(spark, "token-files")
    files = with_bases(spark, write_tokens(docs, folder, tokenizer_path, end_id, width, id_col, text_col))
    return read_tokens(files, docs.schema[id_col].dataType.simpleString()).withColumnRenamed("id", id_col)

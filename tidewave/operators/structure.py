"""A structural audit of a release: one scan of its file tree as rows, rules as joins against what should be there.

    tree = structure.file_tree(spark, root)
    faults = structure.audit(tree, expected, layout)

The tree has a row per file with what its kind tells: headers of recordings and arrays, tables' rows and sidecars' settings as text. Arrays and data files are listed by size and read
at their headers only. Every fault is a row (rule, path, detail); an audit without rows passed.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import _opened
from ..sources.recording_source import FORMATS

TREE = "path string, size long, kind string, text string, arrays map<string, struct<shape:array<long>,dtype:string>>, fault string"
FAULT = "rule string, path string, detail string"
#: Suffixes whose files are read whole as text, and those of which only array headers are read.
TEXTS, ARRAYS = (".vhdr", ".vmrk", ".tsv", ".json"), (".npy", ".npz")


def _array_header(f) -> dict:
    version = np.lib.format.read_magic(f)
    shape, _, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    return {"shape": [int(n) for n in shape], "dtype": "object" if dtype.hasobject else dtype.name}


def _looked_at(path: str) -> tuple[str | None, dict, str | None]:
    """Text, array headers and fault of a file."""
    try:
        with _opened(path) as f:
            if path.endswith(TEXTS):
                text = f.read().decode("utf-8-sig")
                if path.endswith(".json"):
                    json.loads(text)
                return text, {}, None
            if path.endswith(".npy"):
                return None, {"": _array_header(f)}, None
            if path.endswith(".npz"):
                with zipfile.ZipFile(f) as z:
                    return None, {n.removesuffix(".npy"): _array_header(io.BytesIO(z.open(n).read(4096))) for n in z.namelist()}, None
    except (OSError, ValueError, KeyError, EOFError, zipfile.BadZipFile) as e:
        return None, {}, f"{type(e).__name__}: {e}"
    return None, {}, None


def file_tree(spark: SparkSession, root: str) -> DataFrame:
    """TREE: a row per file under root, path relative to it; kind is the suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    at = root.rstrip("/").split("://")[-1].split(":", 1)[-1]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, size in pdf.itertuples(index=False):
                text, arrays, fault = _looked_at(path)
                name = path[path.index(at) + len(at) :].lstrip("/")
                rows.append((name, size, "." + name.rpartition(".")[2] if "." in name.rpartition("/")[2] else "", text, arrays, fault))
            yield pd.DataFrame(rows, columns=["path", "size", "kind", "text", "arrays", "fault"])

    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInPandas(look, TREE)


def _fault(rule: str, rows: DataFrame, detail: Column | None = None) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), "path", (detail if detail is not None else F.lit("")).cast("string").alias("detail"))


def unreadable(tree: DataFrame) -> DataFrame:
    return _fault("unreadable", tree.where("fault IS NOT NULL"), F.col("fault"))


def coverage_faults(tree: DataFrame, expected: DataFrame, within: Column | None = None) -> DataFrame:
    """Files of `expected` (path) that are missing; with `within`, files it holds for that are not expected."""
    out = _fault("missing", expected.select("path").distinct().join(tree.select("path"), "path", "left_anti"))
    return out if within is None else out.unionByName(_fault("unexpected", tree.where(within).join(expected.select("path"), "path", "left_anti")))


def _folder(path: str = "path") -> Column:
    return F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)


def _setting(key: str) -> Column:
    return F.regexp_extract("text", rf"(?m)^{key}\s*=\s*(.+?)\s*$", 1)


def headers(tree: DataFrame) -> DataFrame:
    """path, stem, channels, rate, width (bytes a sample of a channel), data (path) of recordings' headers."""
    h = tree.where("kind = '.vhdr' AND text IS NOT NULL")
    widths = F.create_map(*[F.lit(x) for k, t in FORMATS.items() for x in (k, np.dtype(t).itemsize)])
    return h.select("path", F.regexp_replace("path", r"_eeg\.vhdr$", "").alias("stem"), _setting("NumberOfChannels").try_cast("int").alias("channels"), (1e6 / _setting("SamplingInterval").try_cast("double")).alias("rate"), widths[_setting("BinaryFormat")].alias("width"), F.concat(_folder(), _setting("DataFile")).alias("data"))


def link_faults(tree: DataFrame) -> DataFrame:
    """Files that headers and markers name and that aren't there."""
    named = tree.where("kind IN ('.vhdr', '.vmrk') AND text IS NOT NULL")
    keys = F.when(F.col("kind") == ".vhdr", F.array(F.lit("DataFile"), F.lit("MarkerFile"))).otherwise(F.array(F.lit("DataFile")))
    links = named.withColumn("key", F.explode(keys)).withColumn("to", F.when(F.col("key") == "DataFile", _setting("DataFile")).otherwise(_setting("MarkerFile")))
    links = links.withColumn("target", F.concat(_folder(), "to"))
    return _fault("broken link", links.join(tree.select(F.col("path").alias("target")), "target", "left_anti"), F.concat_ws("=", "key", "to"))


def header_faults(tree: DataFrame) -> DataFrame:
    """Unknown formats, data that isn't a whole number of samples, rates that sidecars contradict, channel tables of another length, and times of recording in markers."""
    h = headers(tree)
    sized = h.join(tree.select(F.col("path").alias("data"), "size"), "data", "left")
    sidecar = tree.where("kind = '.json' AND path LIKE '%_eeg.json'").select(F.regexp_replace("path", r"_eeg\.json$", "").alias("stem"), F.get_json_object("text", "$.SamplingFrequency").try_cast("double").alias("said"))
    counted = tree.where("path LIKE '%_channels.tsv'").select(F.regexp_replace("path", r"_channels\.tsv$", "").alias("stem"), F.size(table_rows()).alias("listed"))
    dated = tree.where("kind = '.vmrk'").where(F.col("text").rlike(r"(?m)^Mk\d+=[^\n]*,\d{20}\s*$"))
    return reduce(
        DataFrame.unionByName,
        [
            _fault("unknown format", h.where("channels IS NULL OR rate IS NULL OR width IS NULL")),
            _fault("incomplete sample", sized.where(F.col("size") % (F.col("channels") * F.col("width")) != 0), F.col("size")),
            _fault("rate", h.join(sidecar, "stem").where("said IS NULL OR said <> rate"), F.col("said")),
            _fault("channel count", h.join(counted, "stem").where("listed <> channels"), F.col("listed")),
            _fault("recording time", dated),
        ],
    )


def table_rows(text: str = "text") -> Column:
    """The rows of a table's text below its names, as arrays of cells."""
    lines = F.filter(F.split(F.regexp_replace(text, "\r", ""), "\n"), lambda x: x != "")
    return F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.split(x, "\t"))


def cells(tables: DataFrame) -> DataFrame:
    """path, row (from 1), cell: a map from the table's names to its cells, of tables of the tree."""
    names = F.split(F.regexp_replace(F.split("text", "\n")[0], "\r", ""), "\t")
    rows = tables.select("path", names.alias("_n"), F.posexplode(table_rows()).alias("row", "_c"))
    padded = F.transform("_n", lambda _, i: F.coalesce(F.get("_c", i), F.lit("")))
    return rows.select("path", (F.col("row") + 1).alias("row"), F.map_from_arrays("_n", padded).alias("cell"))


def _given(c: Column) -> Column:
    return F.when(c.isNotNull() & ~c.isin("", "n/a"), c)


def event_faults(tree: DataFrame, stimuli: str = "stimuli/", rests: int = 1) -> DataFrame:
    """Events outside their recording, stimuli that aren't there, and recordings with another number of rests."""
    e = cells(tree.where("path LIKE '%_events.tsv'")).withColumn("stem", F.regexp_replace("path", r"_events\.tsv$", ""))
    h = headers(tree).join(tree.select(F.col("path").alias("data"), "size"), "data")
    h = h.select("stem", "rate", (F.col("size") / (F.col("channels") * F.col("width") * F.col("rate"))).alias("seconds")).where("seconds IS NOT NULL")
    cell = lambda k: F.element_at("cell", k)
    start, length = cell("onset").try_cast("double"), cell("duration").try_cast("double")
    timed = e.join(h, "stem").where(~F.coalesce((start >= 0) & (length > 0) & (start + length <= F.col("seconds") + 1 / F.col("rate")), F.lit(False)))
    wanted = e.withColumn("target", F.concat(F.lit(stimuli), _given(cell("stim_file")))).where("target IS NOT NULL")
    rested = e.groupBy("path").agg(F.count(F.when(cell("trial_type") == "rest", 1)).alias("n")).where(F.col("n") != rests)
    return _fault("event outside", timed, F.col("row")).unionByName(_fault("missing stimulus", wanted.join(tree.select(F.col("path").alias("target")), "target", "left_anti"), F.col("target"))).unionByName(_fault("rests", rested, F.col("n")))


def array_faults(tree: DataFrame, members: tuple[str, str] = ("eeg_data", "ch_names"), dtype: str = "float32") -> DataFrame:
    """Archives with other members, pickled objects, shapes that don't fit the channel names, and other types; plain arrays with objects or without elements."""
    z = tree.where("kind = '.npz' AND fault IS NULL")
    data, names = (F.col("arrays")[m] for m in members)
    plain = tree.where("kind = '.npy' AND fault IS NULL").withColumn("a", F.col("arrays")[""])
    any_object = F.exists(F.map_values("arrays"), lambda a: a["dtype"] == "object")
    shaped = (F.size(data["shape"]) == 2) & (F.get(data["shape"], F.lit(0)) == F.get(names["shape"], F.lit(0))) & (F.get(data["shape"], F.lit(1)) > 0)
    both = z.where(data.isNotNull() & names.isNotNull())
    return reduce(
        DataFrame.unionByName,
        [
            _fault("archive members", z.where(F.array_sort(F.map_keys("arrays")) != F.array_sort(F.array(*map(F.lit, members)))), F.array_join(F.map_keys("arrays"), ",")),
            _fault("objects", tree.where("fault IS NULL").where(any_object)),
            _fault("archive shape", both.where(~F.coalesce(shaped, F.lit(False)))),
            _fault("archive type", both.where(data["dtype"] != dtype), data["dtype"]),
            _fault("array shape", plain.where(F.exists("a.shape", lambda n: n <= 0))),
        ],
    )


def index_faults(tree: DataFrame, indexes: list[str], id_col: str, ids: list[int]) -> DataFrame:
    """Of the tables named: files in columns called *_file that aren't there, and ids that aren't exactly those given."""
    rows = cells(tree.where(F.col("path").isin(indexes)))
    named = rows.select("path", F.explode("cell").alias("key", "value")).where(F.col("key").endswith("_file") & _given(F.col("value")).isNotNull())
    lost = _fault("missing indexed file", named.join(tree.select(F.col("path").alias("value")), "value", "left_anti"), F.col("value"))
    have = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.element_at("cell", id_col).try_cast("long"))).alias("have"))  # a row a story
    return lost.unionByName(_fault("index ids", have.where(F.col("have") != F.array(*[F.lit(i).cast("long") for i in sorted(ids)])), F.array_join("have", ",")))


def audit(tree: DataFrame, expected: DataFrame, within: Column | None, indexes: list[str], id_col: str, ids: list[int]) -> DataFrame:
    """All faults of a release: FAULT rows, none if it passed. The tree is used many times: pass one that was written."""
    return reduce(DataFrame.unionByName, [unreadable(tree), coverage_faults(tree, expected, within), link_faults(tree), header_faults(tree), event_faults(tree), array_faults(tree), index_faults(tree, indexes, id_col, ids)])


def kind_counts(tree: DataFrame) -> DataFrame:
    """folder, kind, files, bytes."""
    return tree.groupBy(_folder().alias("folder"), "kind").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))

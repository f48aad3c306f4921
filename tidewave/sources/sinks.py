"""Writers with guards: where output may go, what may be overwritten, and what need not be made again."""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
import re
from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import located


def _place(path: str) -> tuple[str, str]:
    """Store and normal path of a URI or a local path; local links are followed."""
    u = urlsplit(path) if re.match(r"[A-Za-z][\w+.-]*:/", path) else None
    if u is None or u.scheme == "file":
        return "file", os.path.realpath(u.path if u else path)
    return f"{u.scheme}://{u.netloc}".lower(), posixpath.normpath(u.path or "/")


def safe_output(output: str, inputs: list[str], new: bool = False) -> str:
    """output (a local path resolved, a URI as it is); an error if it is an input, holds one or lies in one, or (new) exists."""
    store, out = _place(output)
    for i in inputs:
        other, at = _place(i)
        inside = lambda x, y: x == y or x.startswith(y.rstrip("/") + "/")
        if store == other and (inside(out, at) or inside(at, out)):
            raise ValueError(f"output {output} and input {i} overlap")
    if new and _exists(output):
        raise FileExistsError(output)
    return out if store == "file" else output


def _exists(path: str) -> bool:
    from pyarrow import fs

    system, at = located(path)
    return system.get_file_info(at).type != fs.FileType.NotFound


def signature(config: dict) -> str:
    """Digest of a configuration, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def exported(df: DataFrame, columns: list[str], digits: int | None = None) -> DataFrame:
    """The named columns in their order; doubles as %.{digits}g text if asked for."""
    out = df.select(*columns)
    if digits is None:
        return out
    return out.select(*[F.format_string(f"%.{digits}g", F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in out.dtypes])


def write_tsv(df: DataFrame, path: str, separator: str = "\t", gzip: bool = False) -> None:
    df.write.csv(path, sep=separator, header=True, nullValue="n/a", lineSep="\n", compression="gzip" if gzip else "none", mode="errorifexists")


def write_arrays(df: DataFrame, path: str, finite: list[str] | None = None) -> None:
    """Parquet, never over anything that exists; arrays named in finite must hold finite numbers only."""
    for c in finite or []:
        ok = F.forall(c, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
        df = df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(f"{c}: values that aren't finite")).cast("boolean")))
    df.write.mode("errorifexists").parquet(path)


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def manifest(spark: SparkSession, path: str, keys: str) -> DataFrame:
    """What of the table at path was completed: keys (a DDL list) and signature, from the newest manifest that was written to its end; empty where there is none."""
    fs, at = _hadoop(spark, f"{path}.manifest")
    done = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
    done = [p for p in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    schema = f"{keys}, signature string"
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(max(done, key=lambda p: p.getName()).toString())


def resumed_by(spark: SparkSession, path: str, wanted: DataFrame, make: Callable[[DataFrame], DataFrame], keys: str) -> DataFrame:
    """The table at path, partitioned by key, with only those partitions made again whose signature isn't the one they were completed with.

    wanted has the keys and signature of all that should be there (a subject, and the digest of its inputs and settings). make takes the rows of wanted that must be made, and returns
    the table's rows for them with the key columns; their partitions replace what is there, and keys that are not wanted any more leave the table's rows that are returned. The manifest is
    a new folder for each run, written after the data, so a run that dies leaves partitions that will be made again.
    """
    names = [k.split()[0] for k in keys.split(",")]
    repeated = wanted.groupBy(*names).count().where("count > 1")
    if not repeated.isEmpty():
        raise ValueError(f"{path}: a key is wanted twice: {repeated.first()}")
    had = manifest(spark, path, keys)
    todo = wanted.join(had, [*names, "signature"], "left_anti")
    if not todo.isEmpty():
        # keys that are made again are not complete while they are made
        make(todo).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*names).parquet(path)
        fs, at = _hadoop(spark, f"{path}.manifest")
        number = len(fs.listStatus(at)) if fs.exists(at) else 0
        kept = had.join(todo.select(*names), names, "left_anti")
        kept.unionByName(todo.select(*had.columns)).coalesce(1).write.mode("overwrite").parquet(f"{path}.manifest/{number:08d}")
    fs, at = _hadoop(spark, path)
    if not fs.exists(at):
        return make(todo)
    return spark.read.option("basePath", path).parquet(path).join(wanted.select(*names), names, "left_semi")


def resumed(spark: SparkSession, path: str, config: dict, make, on_change: str = "recompute") -> DataFrame:
    """The table at path if it was completed with the same configuration; else made, and kept with its signature.

    on_change: what a table of another configuration leads to, "recompute" or "raise".
    """
    sig = signature(config)
    at = f"{path}/run_signature={sig}"
    jvm = spark._jvm
    fs_path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(fs_path(f"{at}/_SUCCESS")):
        return spark.read.parquet(at)
    if on_change == "raise" and fs.exists(fs_path(path)) and len(fs.listStatus(fs_path(path))):
        raise ValueError(f"{path} was made with another configuration")
    make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)

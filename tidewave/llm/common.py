"""Helpers shared by the corpus operators: the shared work folder, lineage cuts, fixed expressions."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset in local mode (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors and driver share no folder")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-tidewave-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing is ever written to one path twice."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: the lineage ends there, and any executor can read it."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(c, UPPER, LOWER)


def folded_ascii(c: Column) -> Column:
    """A key that is equal for texts that are equal but for the case of A-Z: the UTF-8 bytes, each read as one Latin-1 letter, lower-cased.

    Lower-casing also maps the lead bytes C0-DE to E0-FE; the number of bytes that follow a lead byte still tells which it was, so
    no two texts fall together. It costs a third of lower_ascii, for keys that are hashed or compared only.
    """
    return F.lower(F.decode(c.cast("binary"), "ISO-8859-1"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

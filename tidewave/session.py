"""Session helpers: a session with this library's settings, and the library's code on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once an application, so that functions sent to them can import it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        home = Path(__file__).resolve().parent
        file = os.path.join(tempfile.mkdtemp(prefix="spark-tidewave-"), "tidewave.zip")
        with zipfile.ZipFile(file, "w") as z:
            for p in sorted(home.rglob("*.py")):
                z.write(p, str(p.relative_to(home.parent)))
        spark.sparkContext.addPyFile(file)
        _shipped.add(app)
    return spark


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, bring your own and call ship()."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
    }
    builder = SparkSession.builder.master(master).appName("tidewave")
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


_own: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors and driver share no folder")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="spark-tidewave-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = f"file://{_own[0]}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

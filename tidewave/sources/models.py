"""Hooks for models and codecs that this library doesn't hold: the caller gives a function, Spark runs it by batches.

Nothing here makes up outputs; without a function there is no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decoded_audio(files: DataFrame, decode: Callable[[bytes], np.ndarray], batch: int = 16_000) -> DataFrame:
    """path, t, x: mono samples of binary files (path, content), decoded by the caller's codec."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                x = np.asarray(decode(bytes(c)), np.float32)
                for a in range(0, len(x), batch):
                    yield pd.DataFrame({"path": p, "t": np.arange(a, min(len(x), a + batch)), "x": x[a : a + batch]})

    return files.select("path", "content").mapInPandas(run, "path string, t long, x float")


def embedded(rows: DataFrame, load: Callable[[], Callable[[list], np.ndarray]], x: str, out: str = "y") -> DataFrame:
    """rows with a vector per row; load() is called once a task and gives a function of a batch."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + f", {out} array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            yield pdf.assign(**{out: list(np.asarray(model(pdf[x].tolist()), np.float32))})

    return rows.mapInPandas(run, schema)


def pooled(tokens: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Mean vector per key (token windows to tokens, tokens to words), element by element in SQL."""
    cells = tokens.select(*by, F.posexplode(vector).alias("_i", "_v")).groupBy(*by, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_v"))
    return cells.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"]).alias(vector))

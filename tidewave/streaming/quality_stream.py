"""Streaming forms of batch operators (an extension: the batch programs have no streams)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_quality(stream: DataFrame, at: str, channel: str, x: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Moments and extremes per event-time window and channel, final once the watermark has passed."""
    s = stream.withWatermark(at, late).groupBy(F.window(at, width), channel)
    out = s.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("minimum"), F.max(x).alias("maximum"), F.sum((F.abs(x) > 150).cast("long")).alias("n_high"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), channel, "n", "mean", "std", "minimum", "maximum", "n_high")


def jumps_across_batches(stream: DataFrame, key: str, at: str, x: str, jump: float) -> DataFrame:
    """First differences of `jump` or more per key; the last sample is carried from batch to batch as state."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = jumps = 0
        last = state.get[0] if state.exists else None
        for pdf in batches:
            v = pdf.sort_values(at)[x]
            d = v.diff() if last is None else pd.concat([pd.Series([last]), v]).diff().iloc[1:]
            n, jumps, last = n + len(v), jumps + int((d.abs() >= jump).sum()), float(v.iloc[-1])
        state.update((last,))
        yield pd.DataFrame([(k[0], n, jumps)], columns=[key, "n", "jumps"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, jumps long", "last double", "append", "NoTimeout")

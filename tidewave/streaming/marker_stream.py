"""Markers paired, and channels accumulated, as streams (an extension: the batch programs have no streams)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import quality


class MarkerPairs(StatefulProcessor):
    """Per key: the last marker, the last pair of neighbours that is long enough, and how many there were. After `quiet_ms` of event time without a marker the pair is final and the state goes."""

    def __init__(self, by: list[str], at: str, time: str, least_gap: float, quiet_ms: int):
        self.by = by
        self.at, self.time, self.least, self.quiet = at, time, least_gap, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pairs", "last double, start double, stop double, pairs long")

    def _row(self, key: tuple, start: float | None, stop: float | None, pairs: int, final: bool) -> Row:
        return Row(**dict(zip(self.by, key, strict=True)), start=start, stop=stop, candidate_pair_count=pairs, final=final)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last, start, stop, pairs = self.state.get() if self.state.exists() else (None, None, None, 0)
        newest = 0
        for x, time in sorted((r[self.at], r[self.time]) for r in rows):
            if last is not None and x - last >= self.least:
                start, stop, pairs = last, x, pairs + 1
            last, newest = x, max(newest, int(time.timestamp() * 1000))
        self.state.update((last, start, stop, pairs))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(newest + self.quiet)
        yield self._row(key, start, stop, pairs, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.state.exists():
            _, start, stop, pairs = self.state.get()
            self.state.clear()
            yield self._row(key, start, stop, pairs, True)

    def close(self) -> None:
        pass


def paired_markers(stream: DataFrame, by: list[str], at: str, time: str, least_gap: float, quiet: str = "1 hour", quiet_ms: int = 3_600_000) -> DataFrame:
    """by, start, stop, candidate_pair_count, final: intervals.adjacent_pairs over a stream, a row a key in each batch that touches it (update mode), start null as long as there is no pair.

    time is the event time, by which the watermark moves (`quiet`); a key's markers must come in order from batch to batch. Needs the RocksDB state store.
    """
    schema = ", ".join(f"{b} {stream.schema[b].dataType.simpleString()}" for b in by) + ", start double, stop double, candidate_pair_count long, final boolean"
    timed = stream.withWatermark(time, quiet)
    return timed.groupBy(*by).transformWithState(MarkerPairs(by, at, time, least_gap, quiet_ms), schema, "update", "EventTime")


def _put(path: str, by: list[str], channel: str, order: list[str], x: str, jump: float, batch: DataFrame, number: int) -> None:
    from pyspark.sql import functions as F

    states = quality.channel_accumulators(batch.withColumn("_run", F.lit(number)), by, channel, "_run", order, x, jump)
    states.write.mode("overwrite").parquet(f"{path}/batch={number}")


def accumulated(stream: DataFrame, path: str, by: list[str], channel: str, order: list[str], x: str, jump: float, checkpoint: str | None = None):
    """Start accumulating channels: each batch is a chunk, whose states are written under path (a batch that is repeated replaces its own)."""
    put = partial(_put, path, by, channel, order, x, jump)
    return stream.writeStream.option("checkpointLocation", checkpoint or f"{path}-state-{uuid.uuid4().hex}").trigger(availableNow=True).foreachBatch(put).start()


def accumulated_so_far(spark: SparkSession, path: str, by: list[str], channel: str, jump: float) -> DataFrame:
    """The states of all batches, merged: differences go on from batch to batch."""
    return quality.merged(spark.read.parquet(path).drop("batch"), [*by, channel], jump)

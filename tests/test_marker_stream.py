"""Streams give what the batch operators give, for any cut into batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewave.operators import intervals, quality
from tidewave.streaming import marker_stream

AT = datetime(2024, 1, 1)


def fed(spark, tmp_path, rows, schema, cuts):
    """Rows in order as files, one a batch."""
    folder = tmp_path / "in"
    edges = [0, *cuts, len(rows)]
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:04d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


@pytest.mark.parametrize("cuts", [[], [7, 30], [1, 2, 3, 40]])
def test_pairs_of_any_cut(spark, tmp_path, cuts):
    rng, t, rows = random.Random(1), 0.0, []
    for _ in range(50):
        t += rng.choice([5.0, 40.0, 160.0, 200.0])
        rows.append((rng.choice(["r1", "r2"]), rng.randint(1, 3), t, AT + timedelta(seconds=t)))
    schema = "recording string, event int, onset double, ts timestamp"
    stream = fed(spark, tmp_path, rows, schema, cuts)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = marker_stream.paired_markers(stream, ["recording", "event"], "onset", "ts", 150.0)

        def put(batch, number):
            batch.withColumn("n", F.lit(number)).write.parquet(f"{tmp_path}/out/{number}")

        out.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    found = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out")
    last = found.groupBy("recording", "event").agg(F.max_by(F.struct("start", "stop", "candidate_pair_count"), "n").alias("m")).select("recording", "event", "m.*").where("start IS NOT NULL")
    due = intervals.adjacent_pairs(spark.createDataFrame(rows, schema), ["recording", "event"], ["onset"], "onset", 150.0)
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in due.collect()} and due.count() > 3


@pytest.mark.parametrize("cuts", [[], [60], [3, 50, 51, 170]])
def test_accumulators_of_any_cut(spark, tmp_path, cuts):
    rng = random.Random(2)
    rows = [("s", f"c{i % 2}", i // 2, rng.choice([None, float("nan"), float("inf"), 1.0, 1.0, 90.0, -5.0])) for i in range(200)]
    schema = "subject string, channel string, t int, value double"
    stream = fed(spark, tmp_path, rows, schema, cuts)
    path = f"{tmp_path}/states"
    marker_stream.accumulated(stream, path, ["subject"], "channel", ["t"], "value", 80.0, f"{tmp_path}/check").awaitTermination()
    got = {r["channel"]: r for r in marker_stream.accumulated_so_far(spark, path, ["subject"], "channel", 80.0).collect()}
    df = spark.createDataFrame(rows, schema).withColumn("chunk", F.lit(0))
    due = {r["channel"]: r for r in quality.channel_accumulators(df, ["subject"], "channel", "chunk", ["t"], "value", 80.0).collect()}
    same = ["start", "stop", "first", "minimum", "maximum", "n_samples", "finite", "nonfinite", "zeros", "total", "squares", "flat", "jumps", "differences"]
    for c in ("c0", "c1"):
        assert [got[c][k] for k in same] == [due[c][k] for k in same]

"""Streaming queries, run to the end of what is there (an extension)."""

from pyspark.sql import functions as F

from ..session import work_path
from ..streaming import quality_stream
from .base import query, rounded


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS minimum, max(value) AS maximum, count(*) FILTER (abs(value) > 150) AS n_high FROM events GROUP BY ALL""")
def streaming_window_quality(spark, sf_dir):
    """Event-time windows over the event stream; each batch's changed windows are kept, and the last state of each is read back.

    Files come in any order of time, so nothing is late here.
    """
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, as the stream takes no single file
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    out, work = quality_stream.windowed_quality(stream, "ts", "event_type", "value", late="36500 days"), work_path(spark, "window-stream")

    def put(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{work}/updates/part={number}")

    out.writeStream.outputMode("update").option("checkpointLocation", f"{work}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    names = [c for c in out.columns if c not in ("start", "event_type")]
    last = spark.read.parquet(f"{work}/updates").groupBy("start", "event_type").agg(F.max_by(F.struct(*names), "batch").alias("m"))
    return rounded(last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", *[f"m.{c}" for c in names if c != "stop"]))

"""Exact deduplication as a stateful stream (operator 5).

The documents are read as a stream. Its state, in RocksDB on the executors' disks with no expiry,
has one entry a content digest: how many rows had it, the largest id among them and where that row's
content lies (file and row). When the stream has read all there is, rows whose digest was seen more
than once are hits; each hit is compared, whole text, with the row its state entry points to. Rows
that share only the digest are grouped again by their text, so a weak digest costs time, not truth.

The stream can be resumed: with the same work folder, a later call reads only new files, and the
state goes on from where it was. Each micro-batch reads a bounded number of bytes, so a failed one costs that much.

A digest that very many rows have would make one task of a join long. There are at most four such digests a
partition; they are broadcast, their rows are dealt over salts by their place, and their entry is copied to each salt.

Defined cases: a null text is the empty text; null ids sort below all others; of rows equal in id and
text (ties) the one with the largest place in the files is kept; very long texts are compared whole; an empty table gives an empty result;
further columns are ignored, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, work_path

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # many small stores: no space set aside ahead of need
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Bytes of input that a micro-batch reads at most.
BATCH_BYTES = 256 << 30


def sha256_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _located(df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return df.select(F.col(id_col).alias("id"), text.alias("content"), digest(text).alias("digest"), at.alias("at"))


def run_state(spark: SparkSession, path: str, id_col: str, text_col: str, digest: Callable[[Column], Column], work: str) -> DataFrame:
    """Run the stream over everything in path; the state's entries: digest, n, id, at."""
    schema = spark.read.parquet(path).schema
    glob = f"{path[:-1]}[{path[-1]}]"  # the file stream takes a single file only by a pattern
    rows = _located(spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(glob), id_col, text_col, digest)
    state = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("id", "at")).alias("top"))
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{work}/updates/batch={number}")

        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{work}/state").trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    one = state.schema
    try:
        updates = spark.read.schema(one).parquet(f"{work}/updates/*")
    except Exception as e:  # a stream over an empty folder makes no batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        updates = spark.createDataFrame([], one)
    # n only grows, so an entry's last update is its largest
    last = updates.groupBy("digest").agg(F.max(F.struct("n", "top")).alias("u"))
    return last.select("digest", F.col("u.n").alias("n"), F.col("u.top.id").alias("id"), F.col("u.top.at").alias("at"))


def exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_digest, work: str | None = None) -> DataFrame:
    """One row per row of the Parquet table at path: its id, keep_id, group_size, kept and its digest."""
    work = work or work_path(spark, "exact-dedup")
    state = cut(run_state(spark, path, id_col, text_col, digest, work), "exact-state")
    many = state.where("n > 1").select("digest", F.col("n"), F.col("id").alias("top_id"), F.col("at").alias("top_at"))
    share = max(1, (state.agg(F.sum("n")).first()[0] or 0) // (4 * partitions(spark)))  # a fourth of a task's
    hot = F.broadcast(many.where(F.col("n") > share).select("digest", F.ceil(F.col("n") / share).cast("int").alias("k")))  # so at most 4 a partition

    def dealt(df: DataFrame) -> DataFrame:
        return df.join(hot, "digest", "left").withColumn("salt", F.pmod(F.xxhash64("at"), F.coalesce("k", F.lit(1)))).drop("k")

    def copied(df: DataFrame) -> DataFrame:
        return df.join(hot, "digest", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("k", F.lit(1)).cast("long") - 1))).drop("k")

    keys = ["digest", "salt"]
    docs = dealt(_located(spark.read.parquet(path), id_col, text_col, digest))
    hits = docs.join(copied(many), keys)
    tops = copied(hits.where(F.col("at") == F.col("top_at")).select("digest", F.col("content").alias("top_content")))
    checked = cut(hits.join(tops, keys).select(*keys, "id", "at", (F.col("content") == F.col("top_content")).alias("same")), "exact-checked")
    others = checked.where(~F.col("same"))
    rest = docs.select("id", *keys, "at").join(copied(many), keys, "left")
    if others.isEmpty():
        return rest.select("id", F.coalesce("top_id", "id").alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), (F.col("top_at").isNull() | (F.col("at") == F.col("top_at"))).alias("kept"), "digest")
    unlike = others.groupBy("digest").agg(F.count("*").alias("other_n"))
    rest = rest.join(unlike, "digest", "left").join(others.select(*keys, "at", F.lit(True).alias("is_other")), [*keys, "at"], "left").where("is_other IS NULL")
    true = rest.select("id", F.coalesce("top_id", "id").alias("keep_id"), (F.coalesce("n", F.lit(1)) - F.coalesce("other_n", F.lit(0))).alias("group_size"), (F.col("top_at").isNull() | (F.col("at") == F.col("top_at"))).alias("kept"), "digest")
    texts = docs.join(others.select(*keys, "at"), [*keys, "at"])
    best = texts.groupBy("content").agg(F.count("*").alias("group_size"), F.max(F.struct("id", "at")).alias("top"))
    again = texts.join(best, "content").select("id", F.col("top.id").alias("keep_id"), "group_size", (F.col("at") == F.col("top.at")).alias("kept"), "digest")
    return true.unionByName(again)

"""Audits of datasets: inventories, array comparisons and tables of checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, name: str, key: str, text: str) -> DataFrame:
    n = F.length(text).cast("long")
    return df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("keys"), F.sum(F.col(text).isNull().cast("long")).alias("nulls"), F.min(n).alias("low"), F.max(n).alias("high"))


def compare_arrays(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds same_shape, same_values, same_bits (0.0 and -0.0 differ) and max_abs."""
    diff = F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    bits = F.forall(F.zip_with(a, b, lambda x, y: x.cast("double").cast("string") == y.cast("double").cast("string")), lambda v: F.coalesce(v, F.lit(False)))
    return df.withColumn("same_shape", F.size(a) == F.size(b)).withColumn("max_abs", diff).withColumn("same_values", F.col("same_shape") & (F.col("max_abs") == 0)).withColumn("same_bits", F.col("same_shape") & bits)


def array_profile(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Per key: length, extremes, whether all values are finite, and the robust deviation."""
    v = df.select(*keys, F.explode(F.transform(x, lambda e: e.cast("double"))).alias("v"))
    mid = v.groupBy(*keys).agg(F.median("v").alias("m"))
    joined = v.join(mid, keys)
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.min(~F.isnan("v") & (F.abs("v") < float("inf"))).alias("finite"), (1.4826 * F.median(F.abs(F.col("v") - F.col("m")))).alias("robust_sd"))


def checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule: how many rows were seen and how many broke it."""
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1)), F.lit(0)).alias(f"r{i}") for i, c in enumerate(rules.values())])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col("n"), F.col(f"r{i}").cast("long").alias("broken")) for i, k in enumerate(rules)])).alias("c")).select("c.*").withColumn("passed", F.col("broken") == 0)


def same_content(generated: DataFrame, reference: DataFrame, key: str, content: str) -> DataFrame:
    """EXACT, DIFFERENT or NOT_COMPARABLE by digest of content."""
    a = generated.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("_a"))
    b = reference.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("_b"))
    return a.join(b, key, "left").select(key, F.when(F.col("_b").isNull(), "NOT_COMPARABLE").when(F.col("_a") == F.col("_b"), "EXACT").otherwise("DIFFERENT").alias("status"))

"""How queries are registered: a function of (spark, sf_dir), and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as recordings: subject (user), session (day), channel (type), second, value."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("subject"), F.date_format("ts", "yyyy-MM-dd").alias("session"), F.col("event_type").alias("channel"), F.hour("ts").alias("hour"), "event_id", "ts", "value")


#: The same in SQL.
SAMPLES = "s AS (SELECT user_id AS subject, strftime(ts, '%Y-%m-%d') AS session, event_type AS channel, CAST(hour(ts) AS INT) AS hour, event_id, ts, value FROM events)"


def to_digits(x: Column, digits: int) -> Column:
    """x rounded as the SQL's round does it: the double x * 10 ** digits to the nearest integer, halves away from zero."""
    return F.when(F.abs(x) < 1e300, F.round(x * 10.0**digits) / 10.0**digits).otherwise(x)


def rounded(df: DataFrame, digits: int = 6, other: dict[str, int] | None = None) -> DataFrame:
    """All doubles rounded once, so that the order of sums doesn't show; other: columns with digits of their own."""
    return df.withColumns({c: to_digits(F.col(c), (other or {}).get(c, digits)) for c, t in df.dtypes if t == "double"})


def above(mean: Column, limit: float) -> Column:
    """mean > limit, for means that are the limit but for the order of their sums: those aren't above it."""
    return to_digits(mean, 9) > limit

"""Rounding, means at a limit and Fisher means of registered queries, where the order of sums or a second rounding would show."""

import random

import pytest
from pyspark.sql import functions as F

from tidewave.functions.statistics import fisher_mean
from tidewave.plans import quality_plans
from tidewave.plans.base import rounded


def test_doubles_are_rounded_once(spark):
    df = spark.createDataFrame([(-0.0463496, 0.321905)], "dz double, m double")
    assert rounded(df, 5, {"dz": 4}).first() == (-0.0463, 0.32191)


def test_doubles_are_rounded_as_in_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    xs = [(i * 10 + 5) / 1e6 * (1 + j * 1.2e-16) for i in range(0, 90000, 977) for j in (-1, 0, 1)] + [-2.5, 1e305, float("inf"), None]
    got = rounded(spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double"), 5).orderBy("i").collect()
    assert [r.x for r in got] == [duckdb.execute("SELECT round(?::DOUBLE, 5)", [x]).fetchall()[0][0] for x in xs]


def test_a_fisher_mean_of_one_correlation_is_rounded_as_in_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rs = [*((i * 10 + 5) / 1e6 for i in range(11, 99000, 1013)), 0.321905, 0.876875, -0.321905, 0.0, 1.0, -1.0]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rs)], "i int, r double")
    got = rounded(df.groupBy("i").agg(fisher_mean(F.col("r")).alias("r")), 5).orderBy("i").collect()
    sql = "SELECT round(tanh(avg(atanh(greatest(-0.999999, least(0.999999, ?::DOUBLE))))), 5)"
    assert [r.r for r in got] == [duckdb.execute(sql, [r]).fetchall()[0][0] for r in rs]


def _at_limit(limit: int, n: int = 13) -> list[float]:
    """Values in cents with that mean, whose sum in doubles comes out above it."""
    rng = random.Random(1)
    while True:
        cents = [rng.randrange(200 * limit) for _ in range(n - 1)]
        cents.append(100 * limit * n - sum(cents))
        x, total = [c / 100 for c in cents], 0.0
        for v in x:
            total += v
        if cents[-1] >= 0 and total / n > limit:
            return x


@pytest.mark.parametrize(("query", "limit"), [("session_rollup", 50), ("reason_flags_sorted", 60)])
def test_a_mean_at_the_limit_is_not_above_it(spark, tmp_path, query, limit):
    rows = [(i, v, 1, "click") for i, v in enumerate(_at_limit(limit))]
    events = spark.createDataFrame(rows, "event_id long, value double, user_id long, event_type string").coalesce(1)
    events.withColumn("ts", F.timestamp_seconds(F.col("event_id") + 1_700_000_000)).write.parquet(str(tmp_path / "events.parquet"))
    row = getattr(quality_plans, query)(spark, str(tmp_path)).first()
    assert row["n_bad"] == 0 if query == "session_rollup" else row["bad_reasons"] == ""

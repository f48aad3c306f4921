"""Only what changed is made again."""

import pytest
from pyspark.sql import functions as F

from tidewave.sources import sinks

KEYS = "subject string, day int"


def wanted(spark, rows):
    return spark.createDataFrame(rows, f"{KEYS}, signature string")


def test_changing_one_subject_makes_that_one_again(spark, tmp_path):
    path, made = f"file://{tmp_path}/table", []

    def make(todo):
        made.append(sorted((r["subject"], r["day"]) for r in todo.collect()))
        return todo.select("subject", "day", F.concat("subject", F.lit(":"), "signature").alias("value"), F.explode(F.array(F.lit(1), F.lit(2))).alias("row"))

    rows = [("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x")]
    out = sinks.resumed_by(spark, path, wanted(spark, rows), make, KEYS)
    assert made == [[("a", 1), ("a", 2), ("b", 1)]] and out.count() == 6
    sinks.resumed_by(spark, path, wanted(spark, rows), make, KEYS)
    assert len(made) == 1  # all there
    rows[1] = ("a", 2, "y")
    out = sinks.resumed_by(spark, path, wanted(spark, rows), make, KEYS)
    assert made[1:] == [[("a", 2)]] and {(r["subject"], r["day"], r["value"]) for r in out.collect()} == {("a", 1, "a:x"), ("a", 2, "a:y"), ("b", 1, "b:x")} and out.count() == 6
    out = sinks.resumed_by(spark, path, wanted(spark, [("a", 1, "x"), ("c", 3, "x")]), make, KEYS)
    assert made[2:] == [[("c", 3)]] and {r["subject"] for r in out.collect()} == {"a", "c"} and out.count() == 4  # b is wanted no more


def test_a_run_that_dies_is_made_again(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    rows = wanted(spark, [("a", 1, "x"), ("b", 1, "x")])

    def dies(todo):
        return todo.select("subject", "day", F.when(F.col("subject") == "b", F.raise_error(F.lit("lost")).cast("int")).otherwise(F.lit(1)).alias("value"))

    with pytest.raises(Exception, match="lost"):
        sinks.resumed_by(spark, path, rows, dies, KEYS).count()
    assert sinks.manifest(spark, path, KEYS).count() == 0
    out = sinks.resumed_by(spark, path, rows, lambda todo: todo.select("subject", "day", F.lit(2).alias("value")), KEYS)
    assert [r["value"] for r in out.collect()] == [2, 2]


def test_a_key_wanted_twice_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="twice"):
        sinks.resumed_by(spark, f"file://{tmp_path}/t", wanted(spark, [("a", 1, "x"), ("a", 1, "y")]), lambda todo: todo, KEYS)


def test_outputs_that_would_touch_inputs(tmp_path):
    (tmp_path / "in put").mkdir()
    for out, given in ((f"{tmp_path}/in put/x", f"file://{tmp_path}/in put"), (f"file://{tmp_path}", f"{tmp_path}/in put"), ("hdfs://a/x/../y", "hdfs://A/y/z"), ("s3://b/k", "s3://b/k/")):
        with pytest.raises(ValueError, match="overlap"):
            sinks.safe_output(out, [given])
    assert sinks.safe_output("hdfs://a/x", ["hdfs://b/x", "hdfs://a/xy", "/x"]) == "hdfs://a/x"
    assert sinks.safe_output(f"file://{tmp_path}/out", [f"{tmp_path}/in put"], new=True) == f"{tmp_path}/out"
    with pytest.raises(FileExistsError):
        sinks.safe_output(f"{tmp_path}/in put", [], new=True)

"""Joins with checks, set comparisons and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unique(df: DataFrame, keys: list[str], name: str = "table") -> DataFrame:
    """df, failing when it is run if a key repeats. The check rides on the join's own shuffle by key."""
    counted = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    ok = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{name}: a key repeats: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))).cast("boolean"))
    return counted.where(ok).drop("_n")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return unique(left, keys, "left").join(unique(right, keys, "right"), keys)


def left_replacing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which right's columns replace left's of the same name."""
    return left.drop(*[c for c in right.columns if c not in keys and c in left.columns]).join(right, keys, "left")


def suffixed(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str]) -> DataFrame:
    """Inner join; columns that both have get a suffix."""
    both = (set(left.columns) & set(right.columns)) - set(keys)
    name = lambda df, s: df.select(*[F.col(c).alias(c + s if c in both else c) for c in df.columns])
    return name(left, suffixes[0]).join(name(right, suffixes[1]), keys)


def on_normalized(left: DataFrame, right: DataFrame, left_key: str, right_key: str, normal) -> DataFrame:
    """Inner join on normalised names."""
    return left.withColumn("_k", normal(F.col(left_key))).join(right.withColumn("_k", normal(F.col(right_key))), "_k").drop("_k")


def difference(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only: keys and side ("missing" or "extra")."""
    a, b = (df.select(*keys).distinct() for df in (expected, found))
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("extra")))


def grid(*dimensions: DataFrame) -> DataFrame:
    """All combinations of small dimension tables (subjects, stories): the expected rows of a design, as many as the design has."""
    return reduce(lambda a, b: a.crossJoin(b), dimensions)


def coverage(dimensions: list[DataFrame], found: DataFrame, keys: list[str]) -> DataFrame:
    """The expected grid with present (whether found has it)."""
    have = found.select(*keys).distinct().withColumn("present", F.lit(True))
    return grid(*dimensions).join(have, keys, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def reordered(df: DataFrame, key: str, domain: list) -> DataFrame:
    """One row per value of a fixed domain, in its order (column position), with nulls where df has none."""
    typed = df.schema[key].dataType.simpleString()
    order = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(domain)], f"{key} {typed}, position int")
    return order.join(df, key, "left")


def pivoted(df: DataFrame, by: list[str], column: str, values: list, measure: Column, fill: float | None = None) -> DataFrame:
    out = df.groupBy(*by).pivot(column, values).agg(measure)
    return out.fillna(fill, subset=[str(v) for v in values]) if fill is not None else out


def melted(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, values, name, value)


def stacked(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a frame lacks are null."""
    if not frames:
        raise ValueError("nothing to combine")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def picked(array: str, names: list[str], wanted: list[str]) -> Column:
    """Elements of an array by name, in the order wanted; an unknown name is an error."""
    at = {n: i for i, n in enumerate(names)}
    if gone := [w for w in wanted if w not in at]:
        raise ValueError(f"missing channels: {gone}")
    return F.array(*[F.col(array)[at[w]] for w in wanted])


def lookup(df: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """df with the columns of a lexicon; a key that the lexicon lacks is an error."""
    found = df.join(words.withColumn("_found", F.lit(True)), key, "left")
    ok = F.when(F.col("_found"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not in the lexicon: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))
    return found.where(ok).drop("_found")


def intersection(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """The keys that all frames have."""
    if not frames:
        raise ValueError("nothing to intersect")
    return reduce(lambda a, b: a.join(b, keys, "left_semi"), [f.select(*keys).distinct() for f in frames])


def same_values(wide: DataFrame, long: DataFrame, ids: list[str], values: list[str], name: str, value: str, tolerance: float = 0.0) -> DataFrame:
    """Cells in which a wide table and its long form differ, or that one of them lacks: ids, name, wide, long."""
    a = melted(wide.select(*ids, *values), ids, values, name, "wide")
    both = a.join(long.select(*ids, name, F.col(value).alias("long")), [*ids, name], "full")
    same = (F.col("wide").isNull() & F.col("long").isNull()) | (F.abs(F.col("wide") - F.col("long")) <= tolerance)
    return both.where(~F.coalesce(same, F.lit(False)))


def checked_ids(found: DataFrame, expected: list, key: str) -> DataFrame:
    """found, failing when it is run if an id is not expected or repeats."""
    ok = F.when(F.col(key).isin(expected), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown id: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))
    return unique(found.where(ok), [key], "ids")


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.exceptAll(right)


def same_set(left: DataFrame, right: DataFrame, keys: list[str]) -> bool:
    return difference(left, right, keys).isEmpty()

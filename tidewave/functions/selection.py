"""Exact quantiles and running totals of groups of any size: no task holds a group.

Quantiles are selected by rank. A mergeable sketch per group gives values that enclose a rank; exact counts tell how many rows lie before and between them; while more than
`limit` rows lie between, those are sketched again; the rest are counted by value and summed up in order. Each pass reduces in the tasks first, so a group that holds all
rows costs each task its own share.

Running sums and minima over a whole list are scans: rows are dealt out by range and sorted in their partitions, each partition's total is one row, and what the
partitions before (or behind) add is joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import work_path

#: Values of a sketch, and its error as a part of the rows.
GRID, ACCURACY = 256, 8192
LIMIT = 100_000


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined_keys(rows: DataFrame, per: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows with the other columns of per, joined by keys; null keys are keys like others."""
    other = per.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in per.columns if c not in keys])
    same = [rows[k].eqNullSafe(other[f"_k{i}"]) for i, k in enumerate(keys)]
    return rows.join(other, same or F.lit(True), how).drop(*[f"_k{i}" for i in range(len(keys))])


def exact_quantiles(df: DataFrame, by: list[str], x: str, qs: list[float], limit: int = LIMIT, grid: int = GRID) -> DataFrame:
    """by, n and quantiles, an array in the order of qs: linear between the two nearest values, as percentile() has it. Null and NaN are left out; null keys are groups.

    A rank's place is known to a value of the grid on both sides, so each pass leaves 4 in `grid` of its rows, and rows of one value end at once.
    """
    keys = [f"_g{i}" for i in range(len(by))]
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(x).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    steps = [i / grid for i in range(grid + 1)]
    sketch = F.percentile_approx("_x", steps, ACCURACY).alias("_s")
    first = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), sketch).where("_n > 0"), "sketches")
    at = lambda q: (F.col("_n") - 1) * F.lit(float(q))
    ranks = F.array_distinct(F.array(*[f(at(q)).cast("long") for q in qs for f in (F.floor, F.ceil)]))
    todo = first.select(*keys, "_n", "_s", F.explode(ranks).alias("_r")).select(*keys, "_r", *_enclosing(F.col("_r"), F.col("_n"), grid))
    found: list[DataFrame] = []
    x, low, high = F.col("_x"), F.col("_a"), F.col("_b")
    inside = lambda part: joined_keys(rows, part, keys).where((x > low) & (x < high))
    number = lambda c: F.sum(F.when(c, 1).otherwise(0))
    while True:
        met = joined_keys(rows, cut(todo, "ranks"), keys).groupBy(*keys, "_r", "_a", "_b")
        here = met.agg(number(x < low).alias("_below"), number(x == low).alias("_low"), number((x > low) & (x < high)).alias("_size"), number(x == high).alias("_high"))
        here = here.withColumn("_before", F.col("_below") + F.col("_low")).withColumn("_at", F.col("_r") - F.col("_before"))
        sound = (F.col("_r") >= F.col("_below")) & (F.col("_at") < F.col("_size") + F.col("_high"))
        here = cut(here.where(F.when(sound, F.lit(True)).otherwise(F.raise_error(F.lit("a rank outside its range")).cast("boolean"))), "ranges")
        # the rank is one of the two values, or between them: as values that were tried are left out, every pass gets nearer
        found.append(here.where("_at < 0 OR _at >= _size").select(*keys, "_r", F.when(F.col("_at") < 0, low).otherwise(high).alias("_v")))
        between = here.where("_at >= 0 AND _at < _size")
        few, many = between.where(F.col("_size") <= limit), between.where(F.col("_size") > limit)
        values = inside(few).groupBy(*keys, "_r", "_at", "_x").agg(F.count(F.lit(1)).alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy(*keys, "_r").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))  # `limit` values at most
        picked = values.withColumn("_to", upto).where((F.col("_at") < F.col("_to")) & (F.col("_at") >= F.col("_to") - F.col("_c")))
        found.append(picked.select(*keys, "_r", F.col("_x").alias("_v")))
        if many.isEmpty():
            break
        again = inside(many).groupBy(*keys, "_r", "_at", "_size").agg(sketch)
        todo = again.select(*keys, "_r", *_enclosing(F.col("_at"), F.col("_size"), grid))
    values = reduce(DataFrame.unionByName, found).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_m"))  # two ranks a quantile
    whole = joined_keys(first, values, keys)
    out = []
    for q in qs:
        low, high = F.col("_m")[F.floor(at(q)).cast("long")], F.col("_m")[F.ceil(at(q)).cast("long")]
        out.append(F.when(low == high, low).otherwise((F.ceil(at(q)) - at(q)) * low + (at(q) - F.floor(at(q))) * high))
    return whole.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], F.col("_n").alias("n"), F.array(*out).alias("quantiles"))


def _enclosing(rank: Column, n: Column, grid: int) -> tuple[Column, Column]:
    """Values of the sketch _s on both sides of a rank among n; one further than its place, for the sketch's error."""
    place = rank / F.greatest(n - 1, F.lit(1)) * grid
    low = F.greatest(F.lit(0), F.floor(place).cast("int") - 1)
    high = F.least(F.lit(grid), F.ceil(place).cast("int") + 1)
    return F.element_at("_s", low + 1).alias("_a"), F.element_at("_s", high + 1).alias("_b")


def exact_median(df: DataFrame, by: list[str], x: str, out: str, limit: int = LIMIT) -> DataFrame:
    """by, n, out."""
    return exact_quantiles(df, by, x, [0.5], limit).select(*by, "n", F.col("quantiles")[0].alias(out))


def in_ranges(df: DataFrame, order: list[Column], n: int | None = None) -> DataFrame:
    """df sorted in partitions of rising ranges of `order`, with _part, the partition, and _at, the place in it (from 1); written, so that both stay as they are.

    order must tell all rows apart, or rows that it doesn't may change places.
    """
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*order)
    # the place in a partition: the low 33 bits of the id, which count a partition's rows
    return cut(dealt.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1), "ranged")


def with_ranks(rows: DataFrame, by: list[str], out: str) -> DataFrame:
    """Rows of in_ranges(df, [*by, ...]) with their number (from 1) within by: partition counts give the offsets."""
    counts = rows.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_a0"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", *by, (before - F.col("_a0") + 1).alias("_offset"))  # a row for each partition and the groups in it
    return joined_keys(rows, offsets, ["_part", *by]).withColumn(out, F.col("_offset") + F.col("_at")).drop("_offset")


def with_suffix_minimum(rows: DataFrame, by: list[str], x: Column, out: str) -> DataFrame:
    """Rows of in_ranges(df, [*by, ...]) with the smallest x of each row and all behind it within by: a suffix scan of partitions."""
    rows = rows.withColumn("_x", x)
    least = rows.groupBy("_part", *by).agg(F.min("_x").alias("_l"))
    behind = F.min("_l").over(Window.partitionBy(*by).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1))
    later = least.select("_part", *by, behind.alias("_later"))
    own = F.min("_x").over(Window.partitionBy("_part", *by).orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0))
    return joined_keys(rows.withColumn("_own", own), later, ["_part", *by]).withColumn(out, F.least("_own", "_later")).drop("_x", "_own", "_later")


def ranked_rows(df: DataFrame, by: list[str], order: list[Column], out: str, n: int | None = None) -> DataFrame:
    """df with the row number (from 1) in `order` within by, whatever the groups' sizes."""
    return with_ranks(in_ranges(df, [*map(F.col, by), *order], n), by, out).drop("_part", "_at")

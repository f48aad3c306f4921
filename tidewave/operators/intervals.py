"""Joins of points and intervals, all half-open [start, end), and what is built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.missing import require


def _bucket(c: Column, width: float) -> Column:
    return F.floor(c / width).cast("long")


def points_in_intervals(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Inner join of points with the intervals that hold them.

    Intervals are listed under each bucket of `width` they touch, points under theirs, so the join has an
    equality for Spark to shuffle on; a point meets an interval in one bucket only, so nothing repeats.
    """
    keys = [*(by or []), "_bucket"]
    last = F.greatest(_bucket(F.col(start), width), F.ceil(F.col(end) / width).cast("long") - 1)
    listed = intervals.where(F.col(end) > F.col(start)).withColumn("_bucket", F.explode(F.sequence(_bucket(F.col(start), width), last)))
    joined = points.withColumn("_bucket", _bucket(F.col(at), width)).join(listed, keys)
    return joined.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bucket")


def first_match(points: DataFrame, intervals: DataFrame, point_key: list[str], at: str, start: str, end: str, order: list[str], width: float, by: list[str] | None = None) -> DataFrame:
    """All points, each with the first interval in `order` that holds it, or nulls."""
    names = [c for c in intervals.columns if c not in (by or [])]
    hits = points_in_intervals(points.select(*point_key, *[c for c in (by or []) if c not in point_key], *([] if at in point_key else [at])), intervals, at, start, end, width, by)
    best = hits.groupBy(*point_key).agg(F.min(F.struct(*order, *[c for c in names if c not in order])).alias("_m"))
    return points.join(best, point_key, "left").select(*points.columns, *[F.col(f"_m.{c}").alias(c) for c in names])


def overlapping(left: DataFrame, right: DataFrame, ls: str, le: str, rs: str, re: str, width: float, by: list[str]) -> DataFrame:
    """Pairs of intervals that overlap. Both are listed by bucket; a pair is taken in the first bucket it shares."""
    def listed(df: DataFrame, s: str, e: str) -> DataFrame:
        last = F.greatest(_bucket(F.col(s), width), F.ceil(F.col(e) / width).cast("long") - 1)
        return df.where(F.col(e) > F.col(s)).withColumn("_bucket", F.explode(F.sequence(_bucket(F.col(s), width), last)))

    pairs = listed(left, ls, le).join(listed(right, rs, re), [*by, "_bucket"])
    return pairs.where((F.col(ls) < F.col(re)) & (F.col(le) > F.col(rs)) & (F.col("_bucket") == _bucket(F.greatest(F.col(ls), F.col(rs)), width))).drop("_bucket")


def frames_of(start: Column, end: Column, rate: float) -> tuple[Column, Column]:
    """First and last + 1 frame of an interval; halves go to the even frame."""
    return F.rint(start * rate).cast("long"), F.rint(end * rate).cast("long")


def rasterize(intervals: DataFrame, start: str, end: str, rate: float, order: str, values: list[str], by: list[str], overlap: str = "last") -> DataFrame:
    """by, frame and values: each frame an interval covers. Where several do, the last in `order` wins, or ("error") it fails."""
    lo, hi = frames_of(F.col(start), F.col(end), rate)
    spread = intervals.withColumn("_lo", lo).withColumn("_hi", hi).where("_hi > _lo").withColumn("frame", F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1)))
    top = spread.groupBy(*by, "frame").agg(F.max(F.struct(order, *[v for v in values if v != order])).alias("_m"), F.count(F.lit(1)).alias("_n"))
    if overlap == "error":
        top = top.where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("intervals overlap")).cast("boolean")))
    return top.select(*by, "frame", *[F.col(f"_m.{v}").alias(v) for v in values])


def only_overlap(left: DataFrame, right: DataFrame, key: list[str], ls: str, le: str, rs: str, re: str, width: float, by: list[str]) -> DataFrame:
    """Every left interval with the one right interval it overlaps; none or several are an error."""
    names = [c for c in right.columns if c not in by]
    hits = overlapping(left, right, ls, le, rs, re, width, by).groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*names)).alias("_m"))
    ok = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("an interval overlaps no or several others")).cast("boolean"))
    return left.join(hits, key, "left").where(ok).select(*left.columns, *[F.col(f"_m.{c}").alias(c) for c in names])


def without(frames: DataFrame, excluded: DataFrame, start: str, end: str, rate: float, by: list[str]) -> DataFrame:
    """Frames outside all excluded intervals."""
    lo, hi = frames_of(F.col(start), F.col(end), rate)
    out = excluded.select(*by, lo.alias("_lo"), hi.alias("_hi")).where("_hi > _lo").select(*by, F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1)).alias("frame")).distinct()
    return frames.join(out, [*by, "frame"], "left_anti")


def latest_before(points: DataFrame, marks: DataFrame, by: list[str], at: str, mark_at: str, values: list[str]) -> DataFrame:
    """As-of join: each point with the values of the last mark at or before it. One sort of the union, no pairs."""
    a = points.select("*", *[F.lit(None).cast(marks.schema[v].dataType).alias(f"_v_{v}") for v in values], F.lit(1).alias("_side"), F.col(at).alias("_at"), F.lit(False).alias("_is"))
    b = marks.select(*by, *[F.col(v).alias(f"_v_{v}") for v in values], F.lit(0).alias("_side"), F.col(mark_at).alias("_at"), F.lit(True).alias("_is"))
    w = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    packed = F.when(F.col("_is"), F.struct(*[f"_v_{v}" for v in values]))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_last", F.last(packed, ignorenulls=True).over(w))
    return both.where("_side = 1").select(*points.columns, *[F.col(f"_last._v_{v}").alias(v) for v in values])


def adjacent_pairs(marks: DataFrame, by: list[str], order: list[str], at: str, least_gap: float) -> DataFrame:
    """Neighbouring marks (in `order`) at least least_gap apart: by, start, stop; the last such pair of each key."""
    w = Window.partitionBy(*by).orderBy(*order)
    pairs = marks.withColumn("_start", F.lag(at).over(w)).withColumn("_no", F.row_number().over(w)).where(F.col(at) - F.col("_start") >= least_gap)
    return pairs.groupBy(*by).agg(F.max(F.struct("_no", "_start", at)).alias("_m"), F.count(F.lit(1)).alias("candidate_pair_count")).select(*by, F.col("_m._start").alias("start"), F.col(f"_m.{at}").alias("stop"), "candidate_pair_count")


def best_pair(marks: DataFrame, by: list[str], order: list[str], at: str, expected: Column) -> DataFrame:
    """Of all pairs i < j of a key, the one whose gap is nearest to `expected` (one value a key); ties go to the smallest (i, j).

    `at` may fall along `order`: a key's marks are cut into runs in which it doesn't, and spans of runs are halved again and again, so that
    each pair is within one run or between two halves (marks in time order are one run, and listed twice). In each, goals (at + expected)
    and marks are sorted together: the nearest goal and mark are neighbours, and of equal ones the smallest i and j count. Only where times
    repeat or goals lie behind may it be the next mark of the run. One shuffle, two sorts, no pairs: n log(runs) rows.
    Missing times and keys pair with nothing. As with SQL's min_by, a key of several marks with one time known still has a row without an
    error: that time is its start unless it is the last mark's, and its stop unless it is the first one's.
    The shuffle keeps spark.sql.shuffle.partitions: each mark takes several times its shuffled bytes in the sorts, which AQE wouldn't see.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    until, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    rows = marks.dropna(subset=by).withColumns({"_at": F.col(at), "_goal": F.col(at) + expected}).select(*by, *[c for c in order if c not in by], "_at", "_goal")
    rows = rows.repartition(int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    last = F.last(F.when(F.col("_at").isNotNull(), F.struct("_at", "_goal")), ignorenulls=True)
    rows = rows.withColumns({"_no": F.row_number().over(w), "_i": F.count("_at").over(until), "_first": F.first("_at").over(until), "_last": last.over(before)})
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_at") < F.col("_last._at"), 1).otherwise(0)).over(until))
    rows = rows.withColumn("_halvings", F.max(F.when(F.col("_run") > 0, F.length(F.bin("_run"))).otherwise(0)).over(Window.partitionBy(*by)))

    def pair(i: Column, ai: Column, goal: Column, j: Column, aj: Column) -> Column:
        error = F.abs(aj - goal)
        return F.struct(error.isNull().alias("none"), error.alias("error"), i.cast("long").alias("i"), j.cast("long").alias("j"), ai.alias("ai"), aj.alias("aj"))

    known = (F.col("_at") - F.col("_last._goal")).isNotNull()
    lone = pair(-F.col("_no"), F.col("_last._at"), F.lit(None).cast("double"), F.col("_no"), F.coalesce("_at", F.when(F.col("_first").isNull(), F.col("_last._at"))))  # the key's last mark has the least
    follows = F.when(known & ((F.col("_at") == F.col("_last._at")) | (F.col("_last._goal") <= F.col("_last._at"))), pair(F.col("_i") - 1, F.col("_last._at"), F.col("_last._goal"), F.col("_i"), F.col("_at")))
    follows = follows.when(~known & (F.col("_no") > 1), lone)
    # _k 0 and 1: goals and marks of a run (_level 0); above, goals of the even and marks of the odd one of two neighbouring spans of 2 ** (_level - 1) runs
    listed = rows.withColumn("_follows", follows).withColumn("_k", F.explode(F.expr("sequence(0, 1 + _halvings)"))).withColumn("_level", F.greatest(F.col("_k") - 1, F.lit(0)))
    seeks = F.expr("_k = 0 OR _k > 1 AND shiftright(_run, _level - 1) % 2 = 0")
    listed = listed.select(*by, "_level", F.expr("shiftright(_run, _level)").alias("_span"), F.when(seeks, F.col("_goal")).otherwise(F.col("_at")).alias("_pos"), F.when(seeks, F.col("_at")).alias("_ai"), "_i", F.when(F.col("_k") == 0, F.col("_follows")).alias("_follows"))
    listed = listed.where("_pos IS NOT NULL OR _follows IS NOT NULL")
    so_far = Window.partitionBy(*by, "_level", "_span").orderBy("_pos", F.col("_ai").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    listed = listed.withColumns({  # the greatest place so far, with its smallest i or j
        "_s": F.min(F.expr("CASE WHEN _pos IS NOT NULL AND _ai IS NOT NULL THEN struct(-_pos AS at, _i AS i, _ai AS ai) END")).over(so_far),
        "_t": F.min(F.expr("CASE WHEN _pos IS NOT NULL AND _ai IS NULL THEN struct(-_pos AS at, _i AS j) END")).over(so_far),
    })
    above = F.when(F.expr("_ai IS NULL AND _i > _s.i"), pair(F.col("_s.i"), F.col("_s.ai"), -F.col("_s.at"), F.col("_i"), F.col("_pos")))
    below = F.when(F.expr("_ai IS NOT NULL AND _t.j > _i"), pair(F.col("_i"), F.col("_ai"), F.col("_pos"), F.col("_t.j"), -F.col("_t.at")))
    best = listed.groupBy(*by).agg(F.min(F.array_min(F.array(above, below, "_follows"))).alias("_m")).where("_m IS NOT NULL")
    return best.select(*by, F.col("_m.ai").alias("start"), F.col("_m.aj").alias("stop"), F.col("_m.error").alias("error"))


def words_of_tokens(tokens: DataFrame, words: DataFrame, by: list[str], start: str, end: str, word_start: str, word_end: str, values: list[str]) -> DataFrame:
    """Each token with the values of the last word that begins at or before it; a token before the first word, or that ends behind its word, is an error."""
    found = latest_before(tokens, words.withColumn("_end", F.col(word_end)), by, start, word_start, [*values, "_end"])
    return require(found, F.col(end) <= F.col("_end"), "a token that isn't within a word").drop("_end")

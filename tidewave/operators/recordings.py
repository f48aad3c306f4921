"""Recordings and their annotations: trials, segments, marker streams, completeness and releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.selection import ranked_rows
from ..functions.statistics import fisher_mean
from .intervals import adjacent_pairs
from .relational import coverage
from .retrieval import leave_one_out


def trials_of_groups(groups: DataFrame, trials: DataFrame) -> DataFrame:
    """groups (group_id, first, last) as trials; an error if a trial lies in two groups or in none."""
    each = groups.withColumn("trial", F.explode(F.sequence("first", "last")))
    counted = trials.select("trial").distinct().join(each.groupBy("trial").agg(F.count(F.lit(1)).alias("_n"), F.min("group_id").alias("group_id")), "trial", "left")
    return counted.where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("trial in no or several groups: "), F.col("trial").cast("string"))).cast("boolean"))).drop("_n")


def segments(samples: DataFrame, events: DataFrame, by: list[str], t: str, rate: float) -> DataFrame:
    """Samples of each event (start and duration in seconds); the sample at the stop belongs to it."""
    lo = F.rint(F.col("start") * rate).cast("long")
    hi = lo + F.rint(F.col("duration") * rate).cast("long")
    spread = events.withColumn("_lo", lo).withColumn("_hi", hi).where("_hi >= _lo").withColumn(t, F.explode(F.sequence("_lo", "_hi"))).withColumn("segment_t", F.col(t) - F.col("_lo"))
    return samples.join(spread.drop("_lo", "_hi"), [*by, t])


def markers_to_intervals(markers: DataFrame, by: list[str], order: list[str], at: str, rest_id: str, least: float) -> DataFrame:
    """A marker stream as one interval per event: the last neighbouring pair of each id that is long enough; rest_id becomes "rest"."""
    pairs = adjacent_pairs(markers, by, order, at, least)
    kind = F.when(F.col(by[-1]) == rest_id, "rest").otherwise("speech")
    return pairs.select(*by[:-1], kind.alias("trial_type"), F.when(F.col(by[-1]) != rest_id, F.col(by[-1])).alias("story_id"), F.col("start").alias("onset"), (F.col("stop") - F.col("start")).alias("duration"), "candidate_pair_count", F.lit("last_adjacent").alias("selection_rule"))


def completeness(dimensions: list[DataFrame], lengths: DataFrame, keys: list[str], have: str, need: str) -> DataFrame:
    """The expected grid with present, lengths and trailing samples; a recording shorter than its feature is an error."""
    grid = coverage(dimensions, lengths, keys).join(lengths.select(*keys, have, need), keys, "left")
    tail = F.col(have) - F.col(need)
    ok = F.when(F.coalesce(tail >= 0, F.lit(True)), F.lit(True)).otherwise(F.raise_error(F.lit("a recording ends before its feature")).cast("boolean"))
    return grid.where(ok).withColumn("trailing", tail)


def trial_aggregates(trials: DataFrame, windows: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """Trials with aggregates of their windows; null where a trial has none."""
    return trials.join(windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_windows"), *[c.alias(n) for n, c in measures.items()]), keys, "left").withColumn("n_windows", F.coalesce("n_windows", F.lit(0)))


def aligned(left: DataFrame, right: DataFrame, by: list[str], t: str) -> DataFrame:
    """Two series at the same samples, cut to the length both have."""
    n = lambda df: df.groupBy(*by).agg((F.max(t) + 1).alias("_n"))
    both = n(left).join(n(right).withColumnRenamed("_n", "_m"), by).select(*by, F.least("_n", "_m").alias("_len"))
    return left.join(right, [*by, t]).join(both, by).where(F.col(t) < F.col("_len")).drop("_len")


def task_against_rest(task: DataFrame, rest: DataFrame, trial: str, subject: str, channel: str, t: str, x: str) -> DataFrame:
    """Leave-one-out correlation of each trial and of the rest recording cut to the trial's length: trial, channel, subject, r_task, r_rest.

    Rest is correlated once for each distinct length, not for each trial.
    """
    length = task.groupBy(trial).agg((F.max(t) + 1).alias("length"))
    places = length.select("length").distinct().withColumn(t, F.explode(F.sequence(F.lit(0).cast("long"), F.col("length").cast("long") - 1)))  # a length holds these
    cut = rest.withColumn(t, F.col(t).cast("long")).join(places, t)
    r_rest = leave_one_out(cut, ["length", channel], subject, t, x).select("length", channel, subject, F.col("r").alias("r_rest"))
    r_task = leave_one_out(task, [trial, channel], subject, t, x).select(trial, channel, subject, F.col("r").alias("r_task"))
    return r_task.join(length, trial).join(r_rest, ["length", channel, subject], "left").drop("length")


def isc_by_trial(r: DataFrame, trial: list[str], channel: str, measures: list[str]) -> DataFrame:
    """trial and each measure over the whole head: correlations are averaged over subjects within a channel, then over channels on the Fisher scale."""
    per = r.groupBy(*trial, channel).agg(*[F.avg(m).alias(m) for m in measures])
    return per.groupBy(*trial).agg(*[fisher_mean(F.col(m)).alias(m) for m in measures])


def isc_by_subject(r: DataFrame, trial: list[str], subject: str, measures: list[str]) -> DataFrame:
    """trial, subject and each measure averaged over channels on the Fisher scale."""
    return r.groupBy(*trial, subject).agg(*[fisher_mean(F.col(m)).alias(m) for m in measures])


def rate_by_length(n: Column, seconds: Column, rates: tuple[int, ...] = (50, 100), tolerance: float = 0.05) -> Column:
    """The sampling rate whose length agrees with a duration, or null."""
    out = F.lit(None).cast("int")
    for r in reversed(rates):
        out = F.when(F.abs(n / r - seconds) <= tolerance, F.lit(r)).otherwise(out)
    return out


def to_rate(df: DataFrame, by: list[str], t: str, source: str, target: int) -> DataFrame:
    """Samples at a lower rate by taking every k-th; rates that don't divide are an error."""
    k = F.when(F.col(source) % target == 0, F.col(source) / target).otherwise(F.raise_error(F.lit("the rate is no multiple")).cast("double"))
    return df.withColumn("_k", k.cast("int")).where(F.col(t) % F.col("_k") == 0).withColumn(t, (F.col(t) / F.col("_k")).cast("long")).drop("_k")


def rescaled(df: DataFrame, x: str, condition: Column, factor: float) -> DataFrame:
    """Arrays multiplied by a factor where the condition holds (a unit that one session has)."""
    return df.withColumn(x, F.when(condition, F.transform(x, lambda v: v * F.lit(factor))).otherwise(F.col(x)))


def redacted(df: DataFrame, constants: dict[str, str | None]) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c, v in constants.items()})


def placeholders(texts: DataFrame, text: str = "text") -> DataFrame:
    """Files that still hold a placeholder."""
    return texts.where(F.col(text).rlike("TBD|DO NOT PUBLISH"))


def released(groups: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows numbered within their session, in order, by a scan over ranges: sessions may be of any size. Pass ids only, and join the rest."""
    return ranked_rows(groups, by, [F.col(o) for o in order], "order_within_session")

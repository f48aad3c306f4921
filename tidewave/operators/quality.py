"""Signal quality: windows, channels, sessions and their flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import joined_reasons, reasons
from ..functions.selection import exact_median, exact_quantiles, joined_keys
from ..functions.statistics import log_floor, with_robust_z


def window_quality(samples: DataFrame, window: list[str], channel: str, x: str, high: float = 150.0, peak: float = 1000.0, fraction: float = 0.2, t: str | None = None) -> DataFrame:
    """One row per window: medians over channels of rms and peak to peak, the largest |x - median|, the fraction of it above `high`, and absolute_bad.

    Amplitudes are taken from each channel's median in the window. A window is bad above the peak or the fraction. With t, the samples'
    common time, it also has field_power: the root mean square over time of the deviation between channels.
    """
    w = Window.partitionBy(*window, channel)
    centred = samples.withColumn("_c", F.col(x) - F.median(x).over(w))
    per = centred.groupBy(*window, channel).agg(
        F.sqrt(F.avg(F.col("_c") * F.col("_c"))).alias("rms"),
        (F.max(x) - F.min(x)).alias("ptp"),
        F.max(F.abs("_c")).alias("max_abs"),
        F.sum((F.abs("_c") > high).cast("long")).alias("n_high"),
        F.count(x).alias("n"),
    )
    out = per.groupBy(*window).agg(
        F.median("rms").alias("median_rms"),
        F.median("ptp").alias("median_ptp"),
        F.max("max_abs").alias("max_abs"),
        (F.sum("n_high") / F.sum("n")).alias("high_fraction"),
        F.sum("n").alias("n_samples"),
    )
    if t is not None:
        between = centred.groupBy(*window, t).agg(F.var_pop("_c").alias("_v"))
        out = out.join(between.groupBy(*window).agg(F.sqrt(F.avg("_v")).alias("field_power")), window)
    return out.withColumn("absolute_bad", ((F.col("max_abs") > peak) | (F.col("high_fraction") > fraction)).cast("int"))


#: What states add up, beside the counts above limits.
ADDED = ("n_samples", "finite", "nonfinite", "zeros", "total", "squares", "flat", "jumps", "differences", "r_sum", "r_weight")


def chunk_states(samples: DataFrame, by: list[str], channel: str, chunk: str, order: list[str], x: str, jump: float, flat: float = 1e-9, limits: tuple[float, ...] = (100.0, 150.0, 200.0), every: int | None = 1) -> DataFrame:
    """A state per recording (by), channel and chunk: by, channel, start, stop, first, last, minimum, maximum, ADDED and above_<limit>.

    Null and NaN are missing, infinite values are not finite: both count in nonfinite, neither in the sums. Amplitudes are taken from the chunk's median. A difference to the sample before counts if
    it is finite. r_sum and r_weight are the correlation with the median over channels at every `every`-th place of the chunk, times the places (with None 0). No window
    is larger than a chunk; merged() joins the states of neighbouring chunks. Recordings and channels need keys: rows without one have no correlation.
    """
    keys = [*by, channel]
    w = Window.partitionBy(*keys, chunk)
    rows = samples.select(*keys, chunk, F.struct(*order).alias("_o"), F.col(x).cast("double").alias("_raw")).withColumn("_v", F.when(~F.isnan("_raw"), F.col("_raw")))
    rows = rows.withColumn("_c", F.abs(F.col("_v") - F.median("_v").over(w))).withColumn("_d", F.abs(F.col("_v") - F.lag("_v").over(w.orderBy("_o")))).withColumn("_k", F.row_number().over(w.orderBy("_o")) - 1)
    number = lambda c: F.sum(F.when(c, 1).otherwise(0))
    real = F.coalesce(F.abs("_v") < float("inf"), F.lit(False))
    state = rows.groupBy(*keys, chunk).agg(
        F.min("_o").alias("start"),
        F.max("_o").alias("stop"),
        F.min_by("_v", "_o").alias("first"),
        F.max_by("_v", "_o").alias("last"),
        F.min("_v").alias("minimum"),
        F.max("_v").alias("maximum"),
        F.count(F.lit(1)).alias("n_samples"),
        number(real).alias("finite"),
        number(~real).alias("nonfinite"),
        number(F.col("_v") == 0).alias("zeros"),
        F.coalesce(F.sum(F.when(real, F.col("_v"))), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum(F.when(real, F.col("_v") * F.col("_v"))), F.lit(0.0)).alias("squares"),
        *[number((F.col("_c") > k) & ~F.isnan("_c")).alias(f"above_{k:g}") for k in limits],
        number(_counts("_d") & (F.col("_d") <= flat)).alias("flat"),
        number(_counts("_d") & (F.col("_d") >= jump)).alias("jumps"),
        number(_counts("_d")).alias("differences"),
    )
    if every is None:
        return state.withColumn("r_sum", F.lit(0.0)).withColumn("r_weight", F.lit(0).cast("long")).drop(chunk)
    r = chunk_correlation(rows.where(F.col("_k") % every == 0), by, channel, chunk, "_k", "_v")
    state = state.join(r, [*keys, chunk], "left")
    weight = F.when(F.col("_r").isNotNull(), F.col("_places")).otherwise(F.lit(0).cast("long"))
    return state.withColumn("r_sum", F.coalesce(F.col("_r") * F.col("_places"), F.lit(0.0))).withColumn("r_weight", weight).drop("_r", "_places", chunk)


def _counts(d: str) -> Column:
    """A difference that is finite."""
    return F.coalesce((F.col(d) < float("inf")) & ~F.isnan(d), F.lit(False))


def chunk_correlation(rows: DataFrame, by: list[str], channel: str, chunk: str, place: str, v: str) -> DataFrame:
    """by, channel, chunk, _r, _places: per chunk, a channel's correlation with the median over channels at each place; missing where a variance isn't positive."""
    at = [*by, chunk]
    mid = rows.groupBy(*at, place).agg(F.median(v).alias("_m"))
    mean = mid.groupBy(*at).agg(F.avg("_m").alias("_mm"), F.count(F.lit(1)).alias("_places"))
    mid = mid.join(mean, at).withColumn("_m", F.col("_m") - F.col("_mm"))
    norm = mid.groupBy(*at).agg(F.sum(F.col("_m") * F.col("_m")).alias("_mss"))
    own = rows.groupBy(*at, channel).agg(F.avg(v).alias("_vm"))
    c = F.col(v) - F.col("_vm")
    sums = rows.join(own, [*at, channel]).join(mid.drop("_mm"), [*at, place]).groupBy(*at, channel, "_places").agg(F.sum(c * F.col("_m")).alias("_cross"), F.sum(c * c).alias("_vss"))
    den = F.sqrt(F.col("_vss")) * F.sqrt(F.col("_mss"))
    r = F.when(den > 0, F.col("_cross") / den)
    return sums.join(norm, at).select(*at, channel, F.when(F.abs(r) < float("inf"), r).alias("_r"), "_places")


def merged(states: DataFrame, keys: list[str], jump: float, flat: float = 1e-9) -> DataFrame:
    """One state per key from the states of its runs of samples, which don't overlap: the step from one run's last sample to the next one's first is a difference too.

    It gives states again, so any neighbours may be merged first, whatever the chunks, partitions or batches.
    """
    step = F.abs(F.col("first") - F.lag("last").over(Window.partitionBy(*keys).orderBy("start")))  # a row a chunk
    rows = states.withColumn("_s", step)
    here = {"flat": F.col("_s") <= flat, "jumps": F.col("_s") >= jump, "differences": F.lit(True)}
    adds = [c for c in states.columns if c in ADDED or c.startswith("above_")]
    ends = [F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by("first", "start").alias("first"), F.max_by("last", "start").alias("last"), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum")]
    return rows.groupBy(*keys).agg(*ends, *[F.sum(F.col(c) + F.when(_counts("_s") & here[c], 1).otherwise(0) if c in here else F.col(c)).alias(c) for c in adds]).select(*keys, *[c for c in states.columns if c not in keys])


def channel_accumulators(samples: DataFrame, by: list[str], channel: str, chunk: str, order: list[str], x: str, jump: float, flat: float = 1e-9, limits: tuple[float, ...] = (100.0, 150.0, 200.0), every: int | None = 1) -> DataFrame:
    """One state per recording and channel: chunk_states, merged."""
    return merged(chunk_states(samples, by, channel, chunk, order, x, jump, flat, limits, every), [*by, channel], jump, flat)


def reference_correlation(samples: DataFrame, by: list[str], channel: str, t: str, x: str) -> DataFrame:
    """r of each channel with the median over channels at each time: by, channel, r."""
    mid = F.median(x).over(Window.partitionBy(*by, t))
    return samples.withColumn("_m", mid).groupBy(*by, channel).agg(F.corr(x, "_m").alias("r"))


def channel_rules(nonfinite: Column, flat: Column, high: Column, jumps: Column, r: Column, limits: dict[str, float]) -> dict[str, Column]:
    """The named rules of a bad channel over its accumulated fractions; limits: flat, high, jumps and r."""
    return {"nonfinite": nonfinite > 0, "flat": flat > limits["flat"], "high_amplitude": high > limits["high"], "jumps": jumps > limits["jumps"], "low_correlation": r < limits["r"]}


def finished(acc: DataFrame) -> DataFrame:
    """Means, deviations and fractions of states, over finite samples; the variance is never negative. r is the mean correlation of chunks, by their places."""
    n = F.greatest(F.col("finite"), F.lit(1))
    steps = F.greatest(F.col("differences"), F.lit(1))
    var = F.greatest(F.lit(0.0), F.col("squares") / n - F.pow(F.col("total") / n, 2))
    ratios = [(F.col(c) / n).alias(f"{c}_fraction") for c in acc.columns if c.startswith("above_")]
    return acc.select(
        "*",
        (F.col("total") / n).alias("mean"),
        F.sqrt(var).alias("std"),
        F.sqrt(F.col("squares") / n).alias("rms"),
        (F.col("maximum") - F.col("minimum")).alias("ptp"),
        F.greatest(F.abs("minimum"), F.abs("maximum")).alias("max_abs"),
        (F.col("nonfinite") / F.greatest(F.col("n_samples"), F.lit(1))).alias("nonfinite_fraction"),
        (F.col("zeros") / n).alias("zero_fraction"),
        *ratios,
        (F.col("flat") / steps).alias("flat_fraction"),
        (F.col("jumps") / steps).alias("jump_fraction"),
        F.when(F.col("r_weight") > 0, F.col("r_sum") / F.col("r_weight")).alias("r"),
    )


def robust_statistics(samples: DataFrame, by: list[str], x: str) -> DataFrame:
    """Per group: median, mad (the median distance from it, times 1.4826) and max_abs. Null and NaN are left out; null keys are groups. Groups may be of any size."""
    real = samples.where(F.col(x).isNotNull() & ~F.isnan(x)).select(*by, x)
    mid = joined_keys(real.groupBy(*by).agg(F.max(F.abs(x)).alias("max_abs")), exact_median(real, by, x, "median").drop("n"), by)
    far = joined_keys(real, mid.select(*by, "median"), by).select(*by, F.abs(F.col(x) - F.col("median")).alias("_far"))
    return joined_keys(mid, exact_median(far, by, "_far", "_m").drop("n"), by).select(*by, "median", "max_abs", (F.col("_m") * 1.4826).alias("mad"))


def shape(x: Column) -> tuple[Column, Column]:
    """Population skewness and excess kurtosis."""
    return F.skewness(x), F.kurtosis(x)


def channel_flags(channels: DataFrame, by: list[str], std: str, z_limit: float, rules: dict[str, Column], had: Column | None = None) -> DataFrame:
    """bad_channel and bad_reasons of raw recordings: rules, and variance_outlier for a log10 deviation far from the session's others (a scale of zero is clamped, so one odd channel among equal ones is far)."""
    df = with_robust_z(channels.withColumn("_log", log_floor(F.col(std))), "_log", by, "log_std_z", "clamp").drop("_log")
    return _flagged(df, had, reasons(**rules, variance_outlier=F.abs("log_std_z") > z_limit))


def _flagged(df: DataFrame, had: Column | None, new: Column) -> DataFrame:
    df = df.withColumn("bad_reasons", joined_reasons(had if had is not None else F.lit(""), new))
    return df.withColumn("bad_channel", (F.col("bad_reasons") != "").cast("int"))


def finalized_channels(channels: DataFrame, by: list[str], line: str, muscle: str, z_limit: float, had: Column | None = None) -> DataFrame:
    """Final reasons of channels: earlier ones, line_noise_outlier and muscle_power_outlier (on a log scale) where they lie above the session's other channels."""
    df = with_robust_z(channels, line, by, "line_z")
    df = with_robust_z(df.withColumn("_log", log_floor(F.col(muscle))), "_log", by, "muscle_z").drop("_log")
    return _flagged(df, had, reasons(line_noise_outlier=F.col("line_z") > z_limit, muscle_power_outlier=F.col("muscle_z") > z_limit))


def finalized_sessions(sessions: DataFrame, channels: DataFrame, keys: list[str], across: list[str], metrics: dict[str, bool], bad_windows: str, fraction: float, z_limit: float) -> DataFrame:
    """Sessions with n_channels, n_bad and bad_fraction of their channels, <metric>_z among the sessions of `across`, review_reasons (joined by ;) and flag_for_review.

    metrics: name -> whether it is compared on a log scale. A session without channels has null counts and no reason from them.
    """
    counted = channels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_channels"), F.sum("bad_channel").alias("n_bad"), F.avg("bad_channel").alias("bad_fraction"))
    df = sessions.drop("n_channels", "n_bad", "bad_fraction").join(counted, keys, "left")
    flags = {"many_bad_channels": F.col("bad_fraction") >= fraction, "many_bad_windows": F.col(bad_windows) >= fraction}
    for m, log in metrics.items():
        df = with_robust_z(df.withColumn("_m", log_floor(F.col(m)) if log else F.col(m)), "_m", across, f"{m}_z").drop("_m")
        flags[f"{m}_outlier"] = F.abs(f"{m}_z") > z_limit
    return df.withColumn("review_reasons", F.array_join(reasons(**flags), ";")).withColumn("flag_for_review", (F.col("review_reasons") != "").cast("int"))


def finalized_trials(trials: DataFrame, by: list[str], rms: str, bad_windows: str, n_windows: str, fraction: float, z_limit: float) -> DataFrame:
    """Trials with log_rms_z within their session, review_reasons (each followed by ;) and flag_for_review."""
    df = with_robust_z(trials.withColumn("_log", log_floor(F.col(rms))), "_log", by, "log_rms_z").drop("_log")
    found = reasons(many_bad_windows=F.col(bad_windows) > fraction, rms_outlier=F.abs("log_rms_z") > z_limit, no_quality_windows=F.col(n_windows) == 0)
    df = df.withColumn("review_reasons", F.array_join(F.transform(found, lambda r: F.concat(r, F.lit(";"))), ""))
    return df.withColumn("flag_for_review", (F.col("review_reasons") != "").cast("int"))


def session_rollup(channels: DataFrame, by: list[str], measures: list[str], flag: str = "bad_channel") -> DataFrame:
    return channels.groupBy(*by).agg(F.count(F.lit(1)).alias("n_channels"), F.sum(flag).alias("n_bad"), F.avg(flag).alias("bad_fraction"), *[F.median(m).alias(f"median_{m}") for m in measures])


def low_scores(df: DataFrame, by: list[str], score: str, k: float = 1.5) -> DataFrame:
    """Tukey's lower fence per group, z with the sample deviation, and the rows below the fence flagged. Groups may be of any size."""
    q = exact_quantiles(df, by, score, [0.25, 0.5, 0.75]).drop("n")
    moments = df.groupBy(*by).agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"))
    q = joined_keys(moments, q, by).select(*by, "mean", "std", F.col("quantiles")[1].alias("median"), (F.col("quantiles")[0] - k * (F.col("quantiles")[2] - F.col("quantiles")[0])).alias("fence"))
    return joined_keys(df, q, by).withColumn("z", F.when(F.col("std") > 0, (F.col(score) - F.col("mean")) / F.col("std"))).withColumn("is_low", F.col(score) < F.col("fence"))


def with_counts_of(flagged: DataFrame, tables: list[tuple[DataFrame, list[Column]]], keys: list[str]) -> DataFrame:
    """Each flagged row with aggregates of other tables by its keys: aggregated once each, then joined left."""
    for table, measures in tables:
        flagged = flagged.join(table.groupBy(*keys).agg(*measures), keys, "left")
    return flagged


def trial_statuses(expected: DataFrame, found: DataFrame, keys: list[str], n_names: str, shape: str) -> DataFrame:
    """Expected trials with status: missing, shape_error (neither side of the array has as many rows as there are names), or ok; and channels, samples of those that are ok, turned if they lie on their side."""
    rows = expected.select(*keys).join(found.withColumn("_found", F.lit(True)), keys, "left")
    first, second, names = F.get(shape, F.lit(0)), F.get(shape, F.lit(1)), F.col(n_names)
    upright = (F.size(shape) == 2) & (first == names)
    fits = upright | ((F.size(shape) == 2) & (second == names))
    status = F.when(F.col("_found").isNull(), "missing").when(~F.coalesce(fits, F.lit(False)), "shape_error").otherwise("ok")
    ok = F.col("status") == "ok"
    return rows.withColumn("status", status).withColumn("channels", F.when(ok, names)).withColumn("samples", F.when(ok, F.when(upright, second).otherwise(first))).drop("_found")


def implausible(samples: DataFrame, by: list[str], x: str, low: float, high: float) -> DataFrame:
    """Recordings whose robust deviation (1.4826 MAD) lies outside [low, high], or can't be told: by, mad. Groups may be of any size."""
    robust = robust_statistics(samples, by, x)
    whole = joined_keys(samples.select(*by).distinct(), robust.select(*by, "mad"), by, "left")
    return whole.where(~F.coalesce(F.col("mad").between(low, high), F.lit(False)))

"""Signal-quality queries over the event stream, read as recordings (subject, session, channel)."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names, selection, statistics
from ..operators import quality, windows
from .base import above, SAMPLES, query, rounded, samples, table

_WQ = f"""WITH {SAMPLES},
    c AS (SELECT *, value - median(value) OVER (PARTITION BY session, hour, channel) AS c FROM s),
    per AS (SELECT session, hour, channel, sqrt(avg(c * c)) AS rms, max(value) - min(value) AS ptp, max(abs(c)) AS max_abs,
            count(*) FILTER (abs(c) > 150) AS n_high, count(value) AS n FROM c GROUP BY ALL),
    wq AS (SELECT session, hour, median(rms) AS median_rms, median(ptp) AS median_ptp, max(max_abs) AS max_abs,
            sum(n_high) / sum(n) AS high_fraction, CAST(sum(n) AS BIGINT) AS n_samples FROM per GROUP BY ALL),
    bad AS (SELECT *, CAST(max_abs > 300 OR high_fraction > 0.2 AS INT) AS absolute_bad FROM wq)"""


def _window_quality(spark, sf_dir):
    return quality.window_quality(samples(spark, sf_dir), ["session", "hour"], "channel", "value", peak=300.0)


@query(_WQ + " SELECT session, hour, round(median_rms, 6) AS median_rms, round(median_ptp, 6) AS median_ptp, round(max_abs, 6) AS max_abs, round(high_fraction, 6) AS high_fraction, n_samples, absolute_bad FROM bad")
def window_quality(spark, sf_dir):
    """Hourly tumbling windows."""
    return rounded(_window_quality(spark, sf_dir))


_ROLL = (
    _WQ
    + """, m AS (SELECT *, median(median_rms) OVER (PARTITION BY session) AS mid FROM bad),
    d AS (SELECT *, 1.4826 * median(abs(median_rms - mid)) OVER (PARTITION BY session) AS scale FROM m),
    z AS (SELECT *, CASE WHEN scale > 0 THEN (median_rms - mid) / scale ELSE 0 END AS z FROM d),
    f AS (SELECT *, list_sort(list_filter([CASE WHEN absolute_bad = 1 THEN 'absolute' END, CASE WHEN z > 2 THEN 'high_rms' END, CASE WHEN z < -2 THEN 'low_rms' END], lambda x: x IS NOT NULL)) AS r FROM z)
    SELECT session, count(*) AS n_windows, count(*) FILTER (len(r) > 0) AS n_flagged, round(avg(CAST(len(r) > 0 AS INT)), 6) AS flagged_fraction,
           round(median(median_rms), 6) AS median_rms, round(max(z), 6) AS max_z, string_agg(DISTINCT array_to_string(r, ';'), ',' ORDER BY array_to_string(r, ';')) FILTER (len(r) > 0) AS reasons
    FROM f GROUP BY session"""
)


@query(_ROLL)
def window_quality_rollup(spark, sf_dir):
    """The flagship: windows, robust z within a session, flags with sorted reasons, rolled up by session."""
    wq = statistics.with_robust_z(_window_quality(spark, sf_dir), "median_rms", ["session"], "z")
    new = names.reasons(absolute=F.col("absolute_bad") == 1, high_rms=F.col("z") > 2, low_rms=F.col("z") < -2)
    wq = wq.withColumn("reasons", names.joined_reasons(F.lit(""), new)).withColumn("flag", (F.col("reasons") != "").cast("int"))
    out = wq.groupBy("session").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.sum("flag").alias("n_flagged"),
        F.avg("flag").alias("flagged_fraction"),
        F.median("median_rms").alias("median_rms"),
        F.max("z").alias("max_z"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("flag") == 1, F.col("reasons")))), ",").alias("reasons"),
    )
    return rounded(out.withColumn("reasons", F.when(F.col("reasons") != "", F.col("reasons"))))


_CHAN = f"""WITH {SAMPLES}, ch AS (SELECT subject, channel, stddev_pop(value) AS std, avg(value) AS mean, count(*) AS n FROM s GROUP BY ALL)"""


def _channels(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("subject", "channel").agg(F.stddev_pop("value").alias("std"), F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


@query(_CHAN + """, m AS (SELECT *, median(mean) OVER (PARTITION BY channel) AS mid FROM ch),
    d AS (SELECT *, 1.4826 * median(abs(mean - mid)) OVER (PARTITION BY channel) AS scale FROM m)
    SELECT subject, channel, round(mean, 6) AS mean, round(CASE WHEN scale > 0 THEN (mean - mid) / scale ELSE 0 END, 6) AS z, round((mean - mid) / greatest(scale, 2.220446049250313e-16), 6) AS z_clamped FROM d""")
def group_robust_z(spark, sf_dir):
    """Robust z within a group, both rules for a zero MAD."""
    ch = statistics.with_robust_z(_channels(spark, sf_dir), "mean", ["channel"], "z")
    return rounded(statistics.with_robust_z(ch, "mean", ["channel"], "z_clamped", "clamp").select("subject", "channel", "mean", "z", "z_clamped"))


@query(_CHAN + """, l AS (SELECT *, log10(greatest(std, 2.2250738585072014e-308)) AS x FROM ch),
    m AS (SELECT *, median(x) OVER (PARTITION BY subject) AS mid FROM l), d AS (SELECT *, 1.4826 * median(abs(x - mid)) OVER (PARTITION BY subject) AS scale FROM m)
    SELECT subject, channel, round(CASE WHEN scale > 0 THEN (x - mid) / scale ELSE 0 END, 6) AS log_std_z FROM d""")
def log_robust_z(spark, sf_dir):
    ch = _channels(spark, sf_dir).withColumn("x", statistics.log_floor(F.col("std")))
    return rounded(statistics.with_robust_z(ch, "x", ["subject"], "log_std_z").select("subject", "channel", "log_std_z"))


_STEP = "2.220446049250313e-16"


@query(_CHAN + f""", l AS (SELECT *, log10(greatest(std, 2.2250738585072014e-308)) AS x FROM ch),
    m AS (SELECT *, median(x) OVER w AS mid, median(mean) OVER w AS line_mid FROM l WINDOW w AS (PARTITION BY subject)),
    d AS (SELECT *, 1.4826 * median(abs(x - mid)) OVER w AS scale, 1.4826 * median(abs(mean - line_mid)) OVER w AS line_scale FROM m WINDOW w AS (PARTITION BY subject)),
    z AS (SELECT *, (x - mid) / greatest(scale, {_STEP}) AS raw_z, CASE WHEN scale > {_STEP} THEN (x - mid) / scale ELSE 0 END AS muscle_z, CASE WHEN line_scale > {_STEP} THEN (mean - line_mid) / line_scale ELSE 0 END AS line_z FROM d),
    r AS (SELECT *, list_sort(list_filter([CASE WHEN mean > 60 THEN 'high_mean' END, CASE WHEN n < 5 THEN 'short' END, CASE WHEN abs(raw_z) > 3 THEN 'variance_outlier' END, CASE WHEN line_z > 3 THEN 'line_noise_outlier' END, CASE WHEN muscle_z > 3 THEN 'muscle_power_outlier' END,
        CASE WHEN subject % 2 = 0 THEN 'manual' END], lambda x: x IS NOT NULL)) AS r FROM z)
    SELECT subject, channel, array_to_string(r, ';') AS bad_reasons, CAST(len(r) > 0 AS INT) AS bad_channel FROM r""")
def reason_flags_sorted(spark, sf_dir):
    """Channel flags: rules, robust z and earlier reasons in one sorted list, first of recordings, then final ones within a session."""
    raw = quality.channel_flags(_channels(spark, sf_dir), ["subject"], "std", 3.0, {"high_mean": above(F.col("mean"), 60), "short": F.col("n") < 5}, F.when(F.col("subject") % 2 == 0, "manual;;nan").otherwise("nan"))
    out = quality.finalized_channels(raw, ["subject"], "mean", "std", 3.0, F.col("bad_reasons"))
    return out.select("subject", "channel", "bad_reasons", "bad_channel")


def _z(x: str, by: str, out: str) -> str:
    """CTEs of a robust z, zero where there is no scale."""
    return f"m_{out} AS (SELECT *, median({x}) OVER (PARTITION BY {by}) AS mid FROM {{}}), d_{out} AS (SELECT *, 1.4826 * median(abs({x} - mid)) OVER (PARTITION BY {by}) AS scale FROM m_{out}), z_{out} AS (SELECT * EXCLUDE (mid, scale), CASE WHEN scale > {_STEP} THEN ({x} - mid) / scale ELSE 0 END AS {out} FROM d_{out})"


_LOG = "log10(greatest({}, 2.2250738585072014e-308))"


@query(f"""WITH {SAMPLES}, c AS (SELECT subject, session, channel, CAST(avg(value) > 60 AS INT) AS bad FROM s GROUP BY ALL),
    n AS (SELECT subject, session, count(*) AS n_channels, sum(bad) AS n_bad, avg(bad) AS bad_fraction FROM c GROUP BY ALL),
    t AS (SELECT subject, session, stddev_pop(value) AS spread, avg(value) AS level, avg(CAST(value > 150 AS INT)) AS bad_windows FROM s GROUP BY ALL),
    {_z(_LOG.format("spread"), "session", "spread_z").format("t")}, {_z("level", "session", "level_z").format("z_spread_z")}
    SELECT subject, session, n_channels, CAST(n_bad AS BIGINT) AS n_bad, round(spread_z, 6) AS spread_z, round(level_z, 6) AS level_z,
        array_to_string(list_filter([CASE WHEN bad_fraction >= 0.5 THEN 'many_bad_channels' END, CASE WHEN bad_windows >= 0.5 THEN 'many_bad_windows' END, CASE WHEN abs(spread_z) > 3 THEN 'spread_outlier' END, CASE WHEN abs(level_z) > 3 THEN 'level_outlier' END], lambda x: x IS NOT NULL), ';') AS review_reasons,
        CAST(coalesce(bad_fraction >= 0.5, false) OR bad_windows >= 0.5 OR abs(spread_z) > 3 OR abs(level_z) > 3 AS INT) AS flag_for_review
    FROM z_level_z JOIN n USING (subject, session)""")
def session_review(spark, sf_dir):
    """Sessions finalised: their bad channels counted, measures compared with the other subjects of the day."""
    s = samples(spark, sf_dir)
    channels = s.groupBy("subject", "session", "channel").agg(above(F.avg("value"), 60).cast("int").alias("bad_channel"))
    sessions = s.groupBy("subject", "session").agg(F.stddev_pop("value").alias("spread"), F.avg("value").alias("level"), F.avg((F.col("value") > 150).cast("int")).alias("bad_windows"))
    out = quality.finalized_sessions(sessions, channels, ["subject", "session"], ["session"], {"spread": True, "level": False}, "bad_windows", 0.5, 3.0)
    return rounded(out.select("subject", "session", "n_channels", "n_bad", "spread_z", "level_z", "review_reasons", "flag_for_review"))


@query(f"""WITH {SAMPLES}, t AS (SELECT session, channel, hour, sqrt(avg(value * value)) AS rms, avg(CAST(value > 100 AS INT)) AS bad_windows, count(*) FILTER (value > 1) AS n_windows FROM s GROUP BY ALL),
    {_z(_LOG.format("rms"), "session, channel", "z").format("t")}
    SELECT session, channel, hour, round(z, 6) AS log_rms_z, CASE WHEN bad_windows > 0.3 THEN 'many_bad_windows;' ELSE '' END || CASE WHEN abs(z) > 2.5 THEN 'rms_outlier;' ELSE '' END || CASE WHEN n_windows = 0 THEN 'no_quality_windows;' ELSE '' END AS review_reasons,
        CAST(bad_windows > 0.3 OR abs(z) > 2.5 OR n_windows = 0 AS INT) AS flag_for_review FROM z_z""")
def trial_review(spark, sf_dir):
    """Trials finalised within their recordings."""
    s = samples(spark, sf_dir)
    trials = s.groupBy("session", "channel", "hour").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.avg((F.col("value") > 100).cast("int")).alias("bad_windows"), F.count(F.when(F.col("value") > 1, 1)).alias("n_windows"))
    out = quality.finalized_trials(trials, ["session", "channel"], "rms", "bad_windows", "n_windows", 0.3, 2.5)
    return rounded(out.select("session", "channel", "hour", "log_rms_z", "review_reasons", "flag_for_review"))


@query(_CHAN + """, f AS (SELECT *, CAST(mean > 50 AS INT) AS bad FROM ch)
    SELECT channel, count(*) AS n_channels, CAST(sum(bad) AS BIGINT) AS n_bad, round(avg(bad), 6) AS bad_fraction, round(median(mean), 6) AS median_mean, round(median(std), 6) AS median_std FROM f GROUP BY channel""")
def session_rollup(spark, sf_dir):
    ch = _channels(spark, sf_dir).withColumn("bad_channel", above(F.col("mean"), 50).cast("int"))
    return rounded(quality.session_rollup(ch, ["channel"], ["mean", "std"]))


@query(f"""WITH {SAMPLES}, q AS (SELECT channel, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, avg(value) AS mean, stddev_samp(value) AS std, median(value) AS med FROM s GROUP BY channel)
    SELECT event_id, channel, value, round(a - 1.5 * (b - a), 6) AS fence, round((value - mean) / std, 6) AS z, value < a - 1.5 * (b - a) AS is_low FROM s JOIN q USING (channel)""")
def tukey_low_flags(spark, sf_dir):
    """Tukey's lower fence and z with the sample deviation."""
    out = quality.low_scores(samples(spark, sf_dir).select("event_id", "channel", "value"), ["channel"], "value")
    return rounded(out.select("event_id", "channel", "value", "fence", "z", "is_low"))


@query(f"""WITH {SAMPLES} SELECT event_id, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS z, round(value - avg(value) OVER w, 6) AS centred FROM s WINDOW w AS (PARTITION BY subject, channel)""")
def group_zscore(spark, sf_dir):
    w = Window.partitionBy("subject", "channel")
    return rounded(samples(spark, sf_dir).select("event_id", ((F.col("value") - F.avg("value").over(w)) / F.stddev_samp("value").over(w)).alias("z"), (F.col("value") - F.avg("value").over(w)).alias("centred")))


_ACC = f"""WITH {SAMPLES}, d AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY subject, channel ORDER BY ts, event_id)) AS d, abs(value - median(value) OVER (PARTITION BY subject, channel, session)) AS c FROM s),
    acc AS (SELECT subject, channel, count(*) AS n_samples, count(*) FILTER (value IS NULL OR isnan(value)) AS nonfinite, count(*) FILTER (value = 0) AS zeros, sum(value) AS total, sum(value * value) AS squares, min(value) AS minimum, max(value) AS maximum,
    count(*) FILTER (c > 100) AS above_100, count(*) FILTER (c > 150) AS above_150, count(*) FILTER (c > 200) AS above_200, count(*) FILTER (d <= 1e-9) AS flat, count(*) FILTER (d >= 80) AS jumps, count(d) AS differences FROM d GROUP BY ALL)"""


def _accumulated(spark, sf_dir):
    return quality.channel_accumulators(samples(spark, sf_dir), ["subject"], "channel", "session", ["ts", "event_id"], "value", 80.0, every=None)


@query(_ACC + " SELECT subject, channel, n_samples, nonfinite, zeros, round(total, 4) AS total, round(squares, 4) AS squares, round(minimum, 4) AS minimum, round(maximum, 4) AS maximum, above_100, above_150, above_200, flat, jumps, differences FROM acc")
def channel_accumulators(spark, sf_dir):
    """Counts, sums and extremes per channel, differences carried across chunks."""
    names = ["subject", "channel", "n_samples", "nonfinite", "zeros", "total", "squares", "minimum", "maximum", "above_100", "above_150", "above_200", "flat", "jumps", "differences"]
    return rounded(_accumulated(spark, sf_dir).select(*names), 4)


@query(f"""WITH {SAMPLES}, p AS (SELECT * EXCLUDE (value), CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN 'infinity'::DOUBLE WHEN event_id % 31 = 0 THEN NULL ELSE value END AS v FROM s),
    k AS (SELECT *, row_number() OVER (PARTITION BY subject, session, channel ORDER BY ts, event_id) - 1 AS k, v - lag(v) OVER (PARTITION BY subject, channel ORDER BY ts, event_id) AS d, v - median(v) OVER (PARTITION BY subject, channel, session) AS c FROM p),
    acc AS (SELECT subject, channel, count(*) AS n, count(*) FILTER (isfinite(v)) AS finite, sum(v) FILTER (isfinite(v)) AS total, sum(v * v) FILTER (isfinite(v)) AS squares, min(v) AS minimum, max(v) AS maximum, count(*) FILTER (NOT isnan(c) AND abs(c) > 100) AS above,
        count(*) FILTER (isfinite(d) AND abs(d) >= 80) AS jumps, count(*) FILTER (isfinite(d)) AS differences FROM k GROUP BY ALL),
    mid AS (SELECT subject, session, k, median(v) AS m FROM k GROUP BY ALL), mids AS (SELECT *, m - avg(m) OVER (PARTITION BY subject, session) AS r, count(*) OVER (PARTITION BY subject, session) AS places FROM mid),
    norm AS (SELECT subject, session, sum(r * r) AS rr FROM mids GROUP BY ALL),
    own AS (SELECT k.subject, k.session, k.channel, k.v - avg(k.v) OVER (PARTITION BY k.subject, k.session, k.channel) AS c, r, places FROM k JOIN mids USING (subject, session, k)),
    cor AS (SELECT subject, session, channel, places, sum(c * r) AS cross_, sum(c * c) AS vv FROM own GROUP BY ALL),
    rs AS (SELECT subject, channel, places, CASE WHEN vv > 0 AND rr > 0 AND NOT isinf(vv) AND NOT isnan(vv) AND NOT isnan(cross_) AND NOT isinf(rr) AND NOT isnan(rr) THEN cross_ / (sqrt(vv) * sqrt(rr)) END AS r FROM cor JOIN norm USING (subject, session)),
    w AS (SELECT subject, channel, sum(r * places) / sum(places) FILTER (r IS NOT NULL) AS r FROM rs GROUP BY ALL)
    SELECT subject, channel, n AS n_samples, finite, round(coalesce(total, 0) / greatest(finite, 1), 6) AS mean, round(sqrt(greatest(0, coalesce(squares, 0) / greatest(finite, 1) - pow(coalesce(total, 0) / greatest(finite, 1), 2))), 6) AS std, round((n - finite) / n, 6) AS nonfinite_fraction,
        round(above / greatest(finite, 1), 6) AS above_100_fraction, round(jumps / greatest(differences, 1), 6) AS jump_fraction, differences, round(r, 6) AS r FROM acc JOIN w USING (subject, channel)""")
def channel_states_missing(spark, sf_dir):
    """Accumulators of recordings with planted gaps: missing samples, not-a-number and infinities, and the correlation with the median over channels."""
    e = F.col("event_id")
    v = F.when(e % 23 == 0, F.lit(None)).when(e % 29 == 0, float("inf")).when(e % 31 == 0, float("nan")).otherwise(F.col("value"))
    acc = quality.channel_accumulators(samples(spark, sf_dir).withColumn("value", v), ["subject"], "channel", "session", ["ts", "event_id"], "value", 80.0)
    out = quality.finished(acc).select("subject", "channel", "n_samples", "finite", "mean", "std", "nonfinite_fraction", "above_100_fraction", "jump_fraction", "differences", "r")
    return rounded(out)


@query(_ACC + """ SELECT subject, channel, round(total / n_samples, 6) AS mean, round(sqrt(greatest(0, squares / n_samples - pow(total / n_samples, 2))), 6) AS std, round(sqrt(squares / n_samples), 6) AS rms, round(maximum - minimum, 6) AS ptp,
    round(flat / greatest(differences, 1), 6) AS flat_fraction, round(jumps / greatest(differences, 1), 6) AS jump_fraction FROM acc""")
def channel_statistics(spark, sf_dir):
    """Accumulators turned to means, deviations and fractions."""
    return rounded(quality.finished(_accumulated(spark, sf_dir)).select("subject", "channel", "mean", "std", "rms", "ptp", "flat_fraction", "jump_fraction"))


@query(f"""WITH {SAMPLES} SELECT subject, channel, round(median(value), 6) AS median, round(max(abs(value)), 6) AS max_abs, round(1.4826 * mad(value), 6) AS mad
    FROM s WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL""")
def channel_robust_statistics(spark, sf_dir):
    """Median, scaled median distance from it and largest amplitude per channel."""
    return rounded(quality.robust_statistics(samples(spark, sf_dir), ["subject", "channel"], "value"))


@query(f"""WITH {SAMPLES}, d AS (SELECT *, value - lag(value) OVER (PARTITION BY subject, channel ORDER BY ts, event_id) AS d FROM s)
    SELECT event_id, round(d, 6) AS difference, d IS NOT NULL AND abs(d) >= 80 AS jump FROM d""")
def first_difference_jumps(spark, sf_dir):
    d = F.col("value") - F.lag("value").over(Window.partitionBy("subject", "channel").orderBy("ts", "event_id"))
    return rounded(samples(spark, sf_dir).select("event_id", d.alias("difference"), F.coalesce(F.abs(d) >= 80, F.lit(False)).alias("jump")))


@query(f"""WITH {SAMPLES}, g AS (SELECT channel, avg(value) AS mean, CASE WHEN stddev_pop(value) < 1e-8 THEN 1 ELSE stddev_pop(value) END AS std FROM s GROUP BY channel)
    SELECT event_id, round(greatest(-3, least(3, (value - mean) / std)), 6) AS z FROM s JOIN g USING (channel)""")
def standardized(spark, sf_dir):
    """Moments by group with a floor, joined back, standardised and clipped."""
    s = samples(spark, sf_dir)
    g = s.groupBy("channel").agg(F.avg("value").alias("mean"), statistics.floored_std(F.col("value"), 1e-8).alias("std"))
    z = (F.col("value") - F.col("mean")) / F.col("std")
    return rounded(s.join(g, "channel").select("event_id", F.greatest(F.lit(-3.0), F.least(F.lit(3.0), z)).alias("z")))


@query(f"""WITH {SAMPLES}, m AS (SELECT channel, avg(value) AS a, avg(value * value) AS b, avg(value ** 3) AS c, avg(value ** 4) AS d, stddev_pop(value) AS s FROM s GROUP BY channel)
    SELECT channel, round((c - 3 * a * b + 2 * a ** 3) / s ** 3, 5) AS skewness, round((d - 4 * a * c + 6 * a * a * b - 3 * a ** 4) / s ** 4 - 3, 5) AS kurtosis, round(a, 6) AS mean, round(s, 6) AS std FROM m""")
def shape_moments(spark, sf_dir):
    sk, ku = quality.shape(F.col("value"))
    return samples(spark, sf_dir).groupBy("channel").agg(F.round(sk, 5).alias("skewness"), F.round(ku, 5).alias("kurtosis"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))


@query(f"""WITH {SAMPLES}, n AS (SELECT *, row_number() OVER (PARTITION BY subject, channel ORDER BY ts, event_id) - 1 AS t FROM s), w AS (SELECT *, t // 4 AS "window", count(*) OVER (PARTITION BY subject, channel, t // 4) AS k FROM n)
    SELECT subject, channel, "window", count(*) AS n, round(avg(value), 6) AS mean FROM w WHERE k >= 2 GROUP BY ALL""")
def tumbling_with_tail(spark, sf_dir):
    """Windows of four samples; the last one stays from half its width on."""
    t = windows.numbered(samples(spark, sf_dir), ["subject", "channel"], ["ts", "event_id"])
    return rounded(windows.tumbling(t, ["subject", "channel"], "t", 4, "half").groupBy("subject", "channel", "window").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


@query(f"""WITH {SAMPLES}, n AS (SELECT *, row_number() OVER (PARTITION BY subject, channel ORDER BY ts, event_id) - 1 AS t FROM s), k AS (SELECT subject, channel, max(t) AS last FROM n GROUP BY ALL),
    w AS (SELECT subject, channel, unnest(range(0, (last - 6 + 1) // 3 + 1)) AS window FROM k WHERE last >= 5)
    SELECT subject, channel, w.window, round(avg(value), 6) AS mean, count(*) AS n FROM w JOIN n USING (subject, channel) WHERE t >= 3 * w.window AND t < 3 * w.window + 6 GROUP BY ALL""")
def sliding_windows(spark, sf_dir):
    t = windows.numbered(samples(spark, sf_dir), ["subject", "channel"], ["ts", "event_id"])
    return rounded(windows.sliding(t, ["subject", "channel"], "t", 6, 3).groupBy("subject", "channel", "window").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n")))


@query(f"""WITH {SAMPLES}, n AS (SELECT *, row_number() OVER (PARTITION BY subject, channel ORDER BY ts, event_id) - 1 AS t FROM s), k AS (SELECT subject, channel, max(t) AS last FROM n GROUP BY ALL),
    w AS (SELECT subject, channel, unnest(range(0, (last - 6 + 1) // 3 + 1)) AS window FROM k WHERE last >= 5),
    j AS (SELECT subject, channel, w.window, t, value - avg(value) OVER (PARTITION BY subject, channel, w.window) AS x FROM w JOIN n USING (subject, channel) WHERE t >= 3 * w.window AND t < 3 * w.window + 6)
    SELECT subject, channel, t, round(avg(x), 6) AS value, count(*) AS windows FROM j GROUP BY ALL""")
def overlap_windows_avg(spark, sf_dir):
    t = windows.numbered(samples(spark, sf_dir), ["subject", "channel"], ["ts", "event_id"])
    return rounded(windows.overlap_average(t, ["subject", "channel"], "t", "value", 6, 3)).withColumn("t", F.col("t").cast("long"))


@query(f"""WITH {SAMPLES}, n AS (SELECT *, row_number() OVER (PARTITION BY channel, session ORDER BY ts, event_id) - 1 AS t FROM s) SELECT event_id, CAST(t AS BIGINT) AS t FROM n WHERE t % 7 = 0""")
def decimated(spark, sf_dir):
    """Every seventh sample of each recording, counted from its start."""
    at = samples(spark, sf_dir).select("channel", "session", "ts", "event_id")
    t = selection.ranked_rows(at, ["channel", "session"], [F.col("ts"), F.col("event_id")], "_k").withColumn("t", F.col("_k") - 1)
    return windows.every(t, "t", 7).select("event_id", "t")


@query("""SELECT doc_id, unnest(range(0, length(text), 480)) AS start, least(unnest(range(0, length(text), 480)) + 490, length(text)) AS stop FROM documents WHERE length(text) > 0
    QUALIFY stop - start >= 5""".replace("QUALIFY stop - start >= 5", "").replace("SELECT doc_id", "SELECT * FROM (SELECT doc_id", 1) + ") WHERE stop - start >= 5")
def chunk_slices(spark, sf_dir):
    """Chunks with right context; short ones are left out."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n"))
    return windows.chunks(d, "n", 480, 10, 5).select("doc_id", "start", "stop")


@query("""WITH q AS (SELECT label, avg(v) AS mean, stddev_pop(v) AS std FROM (SELECT label, list_aggregate(embedding, 'avg') AS v FROM embeddings) GROUP BY label)
    SELECT vec_id, round((list_aggregate(embedding, 'avg') - mean) / std, 4) AS z FROM embeddings JOIN q USING (label)""")
def column_zscore(spark, sf_dir):
    """z within a story, population deviation."""
    mean = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size("embedding")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", mean.alias("v"))
    return windows.column_z(e, ["label"], "v", "z").select("vec_id", F.round("z", 4).alias("z"))


@query("""SELECT vec_id, unnest(range(1, len(embedding) + 1)) - 1 AS channel, round(CAST(unnest(embedding) AS DOUBLE) - list_avg(CAST(embedding AS DOUBLE[])), 6) AS x FROM embeddings""")
def average_reference(spark, sf_dir):
    """Each vector less its mean over channels."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(windows.average_reference(F.col("embedding"))).alias("channel", "x"))
    return e.select("vec_id", F.col("channel").cast("long").alias("channel"), F.round("x", 6).alias("x"))


@query(f"""WITH {SAMPLES}, h AS (SELECT session, hour, channel, avg(value) AS v FROM s GROUP BY ALL), m AS (SELECT *, median(v) OVER (PARTITION BY session, hour) AS m FROM h)
    SELECT session, channel, round(corr(v, m), 6) AS r FROM m GROUP BY ALL""")
def reference_correlation(spark, sf_dir):
    """Each channel's hourly course against the median over channels."""
    h = samples(spark, sf_dir).groupBy("session", "hour", "channel").agg(F.avg("value").alias("v"))
    return rounded(quality.reference_correlation(h, ["session"], "channel", "hour", "v"))


@query(_ACC + """, h AS (SELECT subject, session, channel, avg(value) AS v FROM s GROUP BY ALL), m AS (SELECT *, median(v) OVER (PARTITION BY subject, session) AS m FROM h), rc AS (SELECT subject, channel, corr(v, m) AS r FROM m GROUP BY ALL),
    f AS (SELECT subject, channel, rc.r < 0.3 AS e, nonfinite > 0 AS a, flat / greatest(1, differences) > 0.01 AS b, above_150 / n_samples > 0.05 AS c, jumps / greatest(1, differences) > 0.25 AS d FROM acc JOIN rc USING (subject, channel))
    SELECT subject, channel, array_to_string(list_filter([CASE WHEN a THEN 'nonfinite' END, CASE WHEN b THEN 'flat' END, CASE WHEN c THEN 'high_amplitude' END, CASE WHEN d THEN 'jumps' END, CASE WHEN e THEN 'low_correlation' END], lambda x: x IS NOT NULL), ';') AS reasons FROM f""")
def channel_rules(spark, sf_dir):
    """Named rules over accumulated fractions and the correlation of daily courses with the median over channels."""
    from ..functions.names import reasons

    d = F.greatest(F.lit(1), F.col("differences"))
    rules = quality.channel_rules(F.col("nonfinite"), F.col("flat") / d, F.col("above_150") / F.col("n_samples"), F.col("jumps") / d, F.col("r"), {"flat": 0.01, "high": 0.05, "jumps": 0.25, "r": 0.3})
    h = samples(spark, sf_dir).groupBy("subject", "session", "channel").agg(F.avg("value").alias("v"))
    r = quality.reference_correlation(h, ["subject"], "channel", "session", "v")
    return _accumulated(spark, sf_dir).join(r, ["subject", "channel"]).select("subject", "channel", F.array_join(reasons(**rules), ";").alias("reasons"))


@query(f"""WITH {SAMPLES}, n AS (SELECT session, max(hour) + 1 AS n FROM s GROUP BY 1), p AS (SELECT session, n, least(n, 5) AS m, unnest(range(0, least(n, 5))) AS i FROM n),
    t AS (SELECT DISTINCT session, CAST(CASE WHEN m > 1 THEN round_even(i * (n - 1) / (m - 1), 0) ELSE 0 END AS INT) AS hour FROM p)
    SELECT session, hour, count(*) AS n, round(avg(value), 6) AS mean FROM s JOIN t USING (session, hour) GROUP BY ALL""")
def spread_out_chunks(spark, sf_dir):
    """Five hours of each session, spread evenly from the first to the last."""
    some = windows.sampled_chunks(samples(spark, sf_dir), ["session"], "hour", 5)
    return rounded(some.groupBy("session", "hour").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))

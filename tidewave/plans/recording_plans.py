"""Queries over recordings and their annotations."""

from pyspark.sql import functions as F

from ..functions.statistics import paired_summary
from ..operators import recordings, windows
from .base import SAMPLES, SQL, query, rounded, samples, table


@query("""WITH m AS (SELECT user_id AS subject, event_type, event_id, epoch(ts) AS tm FROM events), p AS (SELECT *, lag(tm) OVER w AS s, row_number() OVER w AS n FROM m WINDOW w AS (PARTITION BY subject, event_type ORDER BY event_id))
    SELECT subject, CASE WHEN event_type = 'error' THEN 'rest' ELSE 'speech' END AS trial_type, CASE WHEN event_type <> 'error' THEN event_type END AS story_id, round(max_by(s, n), 3) AS onset, round(max_by(tm - s, n), 3) AS duration, count(*) AS candidate_pair_count, 'last_adjacent' AS selection_rule
    FROM p WHERE tm - s >= 150 GROUP BY subject, event_type""")
def marker_intervals(spark, sf_dir):
    """Marker stream to one interval per event."""
    m = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), "event_type", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("tm"))
    return rounded(recordings.markers_to_intervals(m, ["subject", "event_type"], ["event_id"], "tm", "error", 150), 3)


@query(f"""WITH {SAMPLES}, n AS (SELECT subject, channel, value, row_number() OVER (PARTITION BY subject, channel ORDER BY ts, event_id) - 1 AS t FROM s), e AS (SELECT DISTINCT subject, channel, subject % 4 AS lo, subject % 4 + subject % 3 + 1 AS hi FROM s)
    SELECT n.subject, n.channel, n.t, n.t - lo AS segment_t, value FROM n JOIN e USING (subject, channel) WHERE n.t BETWEEN lo AND hi""")
def event_segments(spark, sf_dir):
    """Samples of an event, the stop's included."""
    n = windows.numbered(samples(spark, sf_dir), ["subject", "channel"], ["ts", "event_id"]).select("subject", "channel", F.col("t").cast("long").alias("t"), "value")
    e = n.select("subject", "channel").distinct().withColumn("start", (F.col("subject") % 4) / 10.0).withColumn("duration", (F.col("subject") % 3 + 1) / 10.0)
    return recordings.segments(n, e, ["subject", "channel"], "t", 10.0).select("subject", "channel", "t", "segment_t", "value")


@query(f"""WITH {SAMPLES}, h AS (SELECT channel, subject, session, dayofyear(session::DATE) - 1 AS t, avg(value) AS v FROM s GROUP BY ALL),
    task AS (SELECT CAST(floor(t / 8) AS INT) AS trial, channel, subject, t % 8 AS t, v FROM h), rest AS (SELECT channel, subject, t, v FROM h),
    len AS (SELECT trial, max(t) + 1 AS length FROM task GROUP BY 1), cut AS (SELECT length, r.* FROM rest r JOIN (SELECT DISTINCT length FROM len) ON t < length),
    k1 AS (SELECT *, (v - avg(v) OVER o) / stddev_pop(v) OVER o AS z, stddev_pop(v) OVER o AS sd FROM task WINDOW o AS (PARTITION BY trial, channel, subject)), k2 AS (SELECT *, (v - avg(v) OVER o) / stddev_pop(v) OVER o AS z, stddev_pop(v) OVER o AS sd FROM cut WINDOW o AS (PARTITION BY length, channel, subject)),
    z1 AS (SELECT * FROM k1 WHERE sd > 0), z2 AS (SELECT * FROM k2 WHERE sd > 0),
    o1 AS (SELECT *, count(*) OVER w AS c, sum(z) OVER w - z AS others FROM z1 WINDOW w AS (PARTITION BY trial, channel, t)), o2 AS (SELECT *, count(*) OVER w AS c, sum(z) OVER w - z AS others FROM z2 WINDOW w AS (PARTITION BY length, channel, t)),
    r1 AS (SELECT trial, channel, subject, corr(z, others / (c - 1)) AS r_task FROM o1 WHERE c > 1 GROUP BY ALL), r2 AS (SELECT length, channel, subject, corr(z, others / (c - 1)) AS r_rest FROM o2 WHERE c > 1 GROUP BY ALL)
    SELECT trial, channel, subject, round(r_task, 6) AS r_task, round(r_rest, 6) AS r_rest FROM r1 JOIN len USING (trial) LEFT JOIN r2 USING (length, channel, subject)""")
def task_rest_isc(spark, sf_dir):
    """Inter-subject correlation of trials of eight days (the last one may be shorter) and of the rest recording at the same length."""
    h = samples(spark, sf_dir).groupBy("channel", "subject", "session", (F.dayofyear(F.col("session").cast("date")) - 1).alias("t")).agg(F.avg("value").alias("v")).drop("session")
    task = h.select(F.floor(F.col("t") / 8).cast("int").alias("trial"), "channel", "subject", (F.col("t") % 8).alias("t"), "v")
    return rounded(recordings.task_against_rest(task, h, "trial", "subject", "channel", "t", "v"))


_FISHER = "round(tanh(avg(atanh(greatest(-0.999999, least(0.999999, {0}))))), 5) AS {0}"


@query(f"WITH r AS ({SQL['task_rest_isc']}), c AS (SELECT trial, channel, avg(r_task) AS r_task, avg(r_rest) AS r_rest FROM r GROUP BY ALL) SELECT trial, {_FISHER.format('r_task')}, {_FISHER.format('r_rest')} FROM c GROUP BY trial")
def isc_trials(spark, sf_dir):
    """Inter-subject correlation of whole trials, and of rest as long: means over subjects, Fisher means over channels."""
    return rounded(recordings.isc_by_trial(task_rest_isc(spark, sf_dir), ["trial"], "channel", ["r_task", "r_rest"]), 5)


@query(f"WITH r AS ({SQL['task_rest_isc']}) SELECT trial, subject, {_FISHER.format('r_task')}, {_FISHER.format('r_rest')} FROM r GROUP BY trial, subject")
def isc_subjects(spark, sf_dir):
    """Each participant's correlation with the others, Fisher means over channels."""
    return rounded(recordings.isc_by_subject(task_rest_isc(spark, sf_dir), ["trial"], "subject", ["r_task", "r_rest"]), 5)


@query(f"""WITH r AS ({SQL['task_rest_isc']}), c AS (SELECT trial, channel, avg(r_task) AS task, avg(r_rest) AS rest FROM r GROUP BY ALL), p AS (SELECT channel, task, rest, task - rest AS d FROM c WHERE task IS NOT NULL AND rest IS NOT NULL),
    s AS (SELECT channel, count(*) AS n, avg(task) AS ma, stddev_samp(task) AS sa, avg(rest) AS mb, stddev_samp(rest) AS sb, avg(d) AS md, stddev_samp(d) AS sd FROM p GROUP BY channel)
    SELECT channel, n, round(ma, 5) AS task_mean, round(sa, 5) AS task_sd, round(mb, 5) AS rest_mean, round(sb, 5) AS rest_sd, round(md, 5) AS mean_difference, round(md / sd, 4) AS dz, round(md / (sd / sqrt(n)), 4) AS t, round((ma - mb) / sqrt(sa * sa / n + sb * sb / n), 4) AS welch_t FROM s""")
def isc_paired(spark, sf_dir):
    """Task against rest by channel: paired differences over trials, effect size, paired and independent t."""
    per = task_rest_isc(spark, sf_dir).groupBy("trial", "channel").agg(F.avg("r_task").alias("task"), F.avg("r_rest").alias("rest"))
    return rounded(paired_summary(per, ["channel"], "task", "rest").drop("welch_df"), 5, dict.fromkeys(("dz", "t", "welch_t"), 4))


@query("""WITH l AS (SELECT l_suppkey AS subject, l_linenumber AS story, count(*) AS eeg, CAST(sum(CAST(l_discount > 0.02 AS INT)) AS BIGINT) AS feature FROM lineitem GROUP BY ALL),
    g AS (SELECT s_suppkey AS subject, story FROM supplier, (SELECT DISTINCT l_linenumber AS story FROM lineitem)) SELECT subject, story, eeg IS NOT NULL AS present, eeg, feature, eeg - feature AS trailing FROM g LEFT JOIN l USING (subject, story)""")
def temporal_completeness(spark, sf_dir):
    """Expected recordings, lengths and trailing samples."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("subject"), F.col("l_linenumber").alias("story")).agg(F.count(F.lit(1)).alias("eeg"), F.sum((F.col("l_discount") > 0.02).cast("long")).alias("feature"))
    dims = [table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("subject")), l.select("story").distinct()]
    return recordings.completeness(dims, l, ["subject", "story"], "eeg", "feature").select("subject", "story", "present", "eeg", "feature", "trailing")


@query(f"""WITH {SAMPLES}, w AS (SELECT subject, session, hour, avg(value) AS m, max(value) AS top FROM s WHERE channel = 'click' GROUP BY ALL), t AS (SELECT DISTINCT subject, session FROM s)
    SELECT t.subject, t.session, count(w.hour) AS n_windows, round(median(m), 6) AS median_m, max(top) AS top, round(avg(CAST(top > 100 AS INT)), 6) AS bad_fraction FROM t LEFT JOIN w USING (subject, session) GROUP BY ALL""")
def trial_window_aggregates(spark, sf_dir):
    """Trials with aggregates of their windows, nulls where there are none."""
    s = samples(spark, sf_dir)
    w = s.where("channel = 'click'").groupBy("subject", "session", "hour").agg(F.avg("value").alias("m"), F.max("value").alias("top"))
    out = recordings.trial_aggregates(s.select("subject", "session").distinct(), w, ["subject", "session"], {"median_m": F.median("m"), "top": F.max("top"), "bad_fraction": F.avg((F.col("top") > 100).cast("int"))})
    return rounded(out)


@query(f"""WITH {SAMPLES}, n AS (SELECT subject, channel, value, row_number() OVER (PARTITION BY subject, channel ORDER BY ts, event_id) - 1 AS t FROM s), a AS (SELECT subject, t, value AS x FROM n WHERE channel = 'click'), b AS (SELECT subject, t, value AS y FROM n WHERE channel = 'view')
    SELECT subject, count(*) AS n, round(corr(x, y), 6) AS r, round(avg(pow(x - y, 2)), 6) AS mse FROM a JOIN b USING (subject, t) GROUP BY subject""")
def aligned_reconstruction(spark, sf_dir):
    """Two series aligned by sample and cut to a common length: error and correlation."""
    n = windows.numbered(samples(spark, sf_dir), ["subject", "channel"], ["ts", "event_id"])
    side = lambda c, x: n.where(F.col("channel") == c).select("subject", "t", F.col("value").alias(x))
    j = recordings.aligned(side("click", "x"), side("view", "y"), ["subject"], "t")
    return rounded(j.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r"), F.avg(F.pow(F.col("x") - F.col("y"), 2)).alias("mse")))


@query("""WITH d AS (SELECT doc_id, length(text) AS n, length(text) / 50.0 + (doc_id % 3) * 0.04 AS seconds FROM documents) SELECT doc_id, CASE WHEN abs(n / 50.0 - seconds) <= 0.05 THEN 50 WHEN abs(n / 100.0 - seconds) <= 0.05 THEN 100 END AS rate FROM d""")
def inferred_rate(spark, sf_dir):
    """The rate at which a length agrees with a duration."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("double").alias("n"))
    return d.select("doc_id", recordings.rate_by_length(F.col("n"), F.col("n") / 50.0 + (F.col("doc_id") % 3) * 0.04).alias("rate"))


@query("""SELECT doc_id, regexp_matches(text, 'TBD|DO NOT PUBLISH') AS placeholder, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS order_within_session, sha256(text) = sha256(trim(text)) AS same FROM documents""")
def release_audit(spark, sf_dir):
    """Placeholders, order within a session and digests of texts and their trimmed copies."""
    d = table(spark, sf_dir, "documents")
    ids = recordings.released(d.select("doc_id", "lang"), ["lang"], ["doc_id"]).select("doc_id", "order_within_session")
    checks = d.select("doc_id", F.col("text").rlike("TBD|DO NOT PUBLISH").alias("placeholder"), (F.sha2(F.col("text").cast("binary"), 256) == F.sha2(F.trim("text").cast("binary"), 256)).alias("same"))
    return checks.join(ids, "doc_id").select("doc_id", "placeholder", "order_within_session", "same")

"""Statistics over groups: correlations, tests, false discovery, retrieval ranks."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import draws
from ..functions import statistics as st
from ..operators import moments, retrieval, windows
from .base import SAMPLES, query, rounded, samples, table

_R = f"""WITH {SAMPLES}, l AS (SELECT *, lag(value) OVER (PARTITION BY subject, channel ORDER BY ts, event_id) AS p FROM s),
    r AS (SELECT subject, channel, corr(value, p) AS r, count(p) AS n FROM l WHERE p IS NOT NULL GROUP BY ALL HAVING count(p) >= 4)"""


def _correlations(spark, sf_dir):
    """Lag-one correlation of each subject's channel."""
    w = Window.partitionBy("subject", "channel").orderBy("ts", "event_id")
    s = samples(spark, sf_dir).withColumn("p", F.lag("value").over(w)).where("p IS NOT NULL")
    return s.groupBy("subject", "channel").agg(F.corr("value", "p").alias("r"), F.count("p").alias("n")).where("n >= 4")


@query(_R + " SELECT channel, round(tanh(avg(atanh(greatest(-0.999999, least(0.999999, r))))), 6) AS fisher, round(tanh(sum(n * atanh(greatest(-0.999999, least(0.999999, r)))) / sum(n)), 6) AS weighted, round(avg(r), 6) AS mean, round(sum(n * r) / sum(n), 6) AS weighted_mean FROM r GROUP BY channel")
def weighted_fisher_mean(spark, sf_dir):
    r = _correlations(spark, sf_dir)
    return rounded(r.groupBy("channel").agg(st.fisher_mean(F.col("r")).alias("fisher"), st.fisher_mean(F.col("r"), F.col("n")).alias("weighted"), F.avg("r").alias("mean"), (F.sum(F.col("n") * F.col("r")) / F.sum("n")).alias("weighted_mean")))


@query(f"""WITH {SAMPLES}, l AS (SELECT channel, value, lag(value, 1) OVER w AS a, lag(value, 2) OVER w AS b, lead(value, 1) OVER w AS f FROM s WINDOW w AS (PARTITION BY channel, subject ORDER BY ts, event_id))
    SELECT channel, round(corr(value, a), 6) AS lag_1, round(corr(value, b), 6) AS lag_2, round(corr(value, f), 6) AS lead_1 FROM l GROUP BY channel""")
def lagged_corr(spark, sf_dir):
    s = windows.numbered(samples(spark, sf_dir), ["channel", "subject"], ["ts", "event_id"])
    s = windows.lagged(s, ["channel", "subject"], "t", "value", [1, 2])
    s = windows.lagged(s, ["channel", "subject"], "t", "value", [-1])
    return rounded(s.groupBy("channel").agg(F.corr("value", "lag_1").alias("lag_1"), F.corr("value", "lag_2").alias("lag_2"), F.corr("value", "lag_m1").alias("lead_1")))


_P = f"""WITH {SAMPLES}, g AS (SELECT subject, channel, avg(value) AS m, count(*) AS n FROM s GROUP BY ALL), p AS (SELECT subject, channel, exp(-abs(m - 50) / 10) AS p FROM g)"""


@query(_P + """, r AS (SELECT *, count(*) OVER (PARTITION BY channel) AS n, row_number() OVER (PARTITION BY channel ORDER BY p) AS k FROM p)
    SELECT subject, channel, round(p, 6) AS p, round(least(1, min(p * n / k) OVER (PARTITION BY channel ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r""")
def bh_fdr(spark, sf_dir):
    """q-values of Benjamini and Hochberg per channel."""
    g = samples(spark, sf_dir).groupBy("subject", "channel").agg(F.avg("value").alias("m"))
    p = g.select("subject", "channel", F.exp(-F.abs(F.col("m") - 50) / 10).alias("p"))
    return rounded(st.benjamini_hochberg(p, "p", "q", ["channel"]))


@query(f"""WITH {SAMPLES}, d AS (SELECT channel, subject % 10 AS i, avg(value) FILTER (hour < 12) - avg(value) FILTER (hour >= 12) AS d FROM s GROUP BY ALL),
    n AS (SELECT channel, list(d ORDER BY i) AS ds FROM d GROUP BY channel), b AS (SELECT channel, ds, unnest(range(0, CAST(2 ** len(ds) AS BIGINT))) AS b FROM n),
    m AS (SELECT channel, abs(list_sum(list_transform(range(1, len(ds) + 1), lambda i: CASE WHEN (b >> (i - 1)) & 1 = 1 THEN -ds[i] ELSE ds[i] END))) >= abs(list_sum(ds)) - 1e-9 AS over FROM b)
    SELECT channel, round((count(*) FILTER (over) + 1) / (count(*) + 1), 6) AS p FROM m GROUP BY channel""")
def sign_flip_exact(spark, sf_dir):
    """All sign patterns of ten group differences, as rows of a sequence."""
    s = samples(spark, sf_dir)
    half = lambda c: F.avg(F.when(c, F.col("value")))
    d = s.groupBy("channel", (F.col("subject") % 10).alias("i")).agg((half(F.col("hour") < 12) - half(F.col("hour") >= 12)).alias("d"))
    ds = d.groupBy("channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "d"))), lambda x: x["d"]).alias("ds"))  # ten numbers
    b = ds.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2.0), F.size("ds")).cast("long") - 1)))
    flipped = F.expr("aggregate(transform(ds, (x, i) -> IF((shiftright(b, i) & 1L) = 1L, -x, x)), cast(0 as double), (s, x) -> s + x)")
    whole = F.expr("aggregate(ds, cast(0 as double), (s, x) -> s + x)")
    return rounded(b.groupBy("channel").agg(((F.sum((F.abs(flipped) >= F.abs(whole) - 1e-9).cast("long")) + 1) / (F.count(F.lit(1)) + 1)).alias("p")))


@query(f"""WITH {SAMPLES}, c AS (SELECT subject, channel, avg(value) AS m FROM s GROUP BY ALL), p AS (SELECT subject, max(m) FILTER (channel = 'click') AS a, max(m) FILTER (channel = 'view') AS b FROM c GROUP BY subject),
    d AS (SELECT a - b AS d FROM p WHERE a IS NOT NULL AND b IS NOT NULL) SELECT count(*) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS std, round(stddev_samp(d) / sqrt(count(*)), 6) AS sem, round(avg(d) / stddev_samp(d), 6) AS dz, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t FROM d""")
def paired_window_diff(spark, sf_dir):
    """Pivot, complete pairs, paired t."""
    from ..operators.relational import pivoted

    m = samples(spark, sf_dir).groupBy("subject", "channel").agg(F.avg("value").alias("m"))
    d = pivoted(m, ["subject"], "channel", ["click", "view"], F.max("m")).dropna(subset=["click", "view"]).select((F.col("click") - F.col("view")).alias("d"))
    sem = F.stddev_samp("d") / F.sqrt(F.count("d"))
    return rounded(d.agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("std"), sem.alias("sem"), (F.avg("d") / F.stddev_samp("d")).alias("dz"), (F.avg("d") / sem).alias("t")))


@query("""WITH a AS (SELECT l_suppkey, l_returnflag, avg(CAST(l_discount > 0.05 AS INT)) AS acc, sum(CAST(l_discount > 0.05 AS INT)) AS k, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT l_returnflag, count(*) AS n_subjects, round(avg(acc), 6) AS macro, round(stddev_samp(acc), 6) AS std, round(stddev_samp(acc) / sqrt(count(*)), 6) AS sem, round(sum(k) / sum(n), 6) AS micro, CAST(sum(k) AS BIGINT) AS correct, CAST(sum(n) AS BIGINT) AS total FROM a GROUP BY 1""")
def micro_macro_accuracy(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").withColumn("c", (F.col("l_discount") > 0.05).cast("int")).groupBy("l_suppkey", "l_returnflag").agg(F.avg("c").alias("acc"), F.sum("c").alias("k"), F.count(F.lit(1)).alias("n"))
    return rounded(a.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_subjects"), F.avg("acc").alias("macro"), F.stddev_samp("acc").alias("std"), (F.stddev_samp("acc") / F.sqrt(F.count(F.lit(1)))).alias("sem"), (F.sum("k") / F.sum("n")).alias("micro"), F.sum("k").alias("correct"), F.sum("n").alias("total")))


@query()
def condition_statistics(spark, sf_dir):
    """Mean, t interval, one-sided t and binomial p-values per condition; the p-values from the incomplete beta function."""
    a = table(spark, sf_dir, "lineitem").withColumn("c", (F.col("l_discount") > 0.05).cast("int")).groupBy("l_suppkey", "l_returnflag").agg(F.avg("c").alias("acc"), F.sum("c").alias("k"), F.count(F.lit(1)).alias("n"))
    g = a.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg("acc").alias("mean"), F.stddev_samp("acc").alias("sd"), F.sum("k").alias("correct"), F.sum("n").alias("total"))
    sem, df = F.col("sd") / F.sqrt("n"), (F.col("n") - 1).cast("double")
    g = g.withColumn("sem", sem).withColumn("t", (F.col("mean") - 0.5) / sem)
    half = st.t_ppf(F.lit(0.975), df) * F.col("sem")
    return g.select("*", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"), st.t_greater("t", df).alias("p_greater"), st.binomial_p(F.col("correct").cast("double"), F.col("total").cast("double"), F.lit(0.5)).alias("p_binomial"))


@query(f"""WITH {SAMPLES}, b AS (SELECT channel, subject, session, avg(value) AS v FROM s GROUP BY ALL), k AS (SELECT *, avg(v) OVER o AS m, stddev_pop(v) OVER o AS sd FROM b WINDOW o AS (PARTITION BY channel, subject)),
    z AS (SELECT *, (v - m) / sd AS z FROM k WHERE sd > 0), o AS (SELECT *, count(*) OVER (PARTITION BY channel, session) AS c, sum(z) OVER (PARTITION BY channel, session) - z AS others FROM z)
    SELECT channel, subject, round(corr(z, others / (c - 1)), 6) AS r, count(*) AS n FROM o WHERE c > 1 GROUP BY ALL""")
def loo_isc(spark, sf_dir):
    """Each subject's daily course against the mean of all others."""
    b = samples(spark, sf_dir).groupBy("channel", "subject", "session").agg(F.avg("value").alias("v"))
    return rounded(retrieval.leave_one_out(b, ["channel"], "subject", "session", "v"))


@query("""WITH e AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings), c AS (SELECT label AS position, list_transform(range(1, 65), lambda i: list_avg(list_transform(list(v), lambda w: w[i]))) AS m FROM e GROUP BY label),
    z AS (SELECT vec_id, label, position, list_dot_product(v, m) / sqrt(list_dot_product(v, v) * list_dot_product(m, m)) AS s FROM e, c)
    SELECT vec_id, CAST(1 + count(*) FILTER (s > p) AS INT) AS positive_rank, arg_min(position, (-s, position)) AS predicted_label, CAST(arg_min(position, (-s, position)) = max(label) AS INT) AS correct, round(max(p), 6) AS positive_score
    FROM (SELECT *, max(s) FILTER (position = label) OVER (PARTITION BY vec_id) AS p FROM z) GROUP BY vec_id""")
def cosine_retrieval_rank(spark, sf_dir):
    """Every vector against the mean vector of each label; the label's rank."""
    e = table(spark, sf_dir, "embeddings")
    cells = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("m")).select(F.col("label").alias("position"), "m")
    # as many candidates as labels, packed in one array and met by each vector
    packed = means.agg(F.collect_list(F.struct("position", "m")).alias("candidates"))
    pairs = e.withColumn("_k", F.lit(1)).join(F.broadcast(packed.withColumn("_k", F.lit(1))), "_k").select("vec_id", "label", "embedding", F.explode("candidates").alias("c"))
    s = pairs.select("vec_id", F.col("c.position").alias("position"), (F.col("c.position") == F.col("label")).alias("positive"), (retrieval.dot(F.col("embedding"), F.col("c.m")) / F.sqrt(retrieval.dot(F.col("embedding"), F.col("embedding")) * retrieval.dot(F.col("c.m"), F.col("c.m")))).alias("s"))
    return rounded(retrieval.ranked(s, ["vec_id"], "position", "s", "positive").select("vec_id", "positive_rank", "predicted_label", "correct", "positive_score"))


@query(f"""WITH {SAMPLES}, h AS (SELECT channel, hour AS t, avg(value) AS v FROM s GROUP BY ALL) SELECT channel, max_by(t, (v, -t)) AS peak_at, round(max(v), 6) AS peak, min_by(t, (v, t)) AS trough_at, round(min(v), 6) AS trough FROM h WHERE t BETWEEN 6 AND 18 GROUP BY channel""")
def peak_in_window(spark, sf_dir):
    """First maximum and minimum of a waveform inside a window."""
    h = samples(spark, sf_dir).groupBy("channel", F.col("hour").alias("t")).agg(F.avg("value").alias("v")).where("t BETWEEN 6 AND 18")
    return rounded(h.groupBy("channel").agg(F.max_by("t", F.struct("v", -F.col("t"))).alias("peak_at"), F.max("v").alias("peak"), F.min_by("t", F.struct("v", "t")).alias("trough_at"), F.min("v").alias("trough")))


@query(f"""WITH {SAMPLES}, h AS (SELECT channel, subject, hour AS t, avg(value) AS v FROM s GROUP BY ALL) SELECT channel, t, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(*)), 6) AS sem FROM h GROUP BY ALL""")
def mean_waveform(spark, sf_dir):
    """Group mean and standard error at each time."""
    h = samples(spark, sf_dir).groupBy("channel", "subject", F.col("hour").alias("t")).agg(F.avg("value").alias("v"))
    return rounded(h.groupBy("channel", "t").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), (F.stddev_samp("v") / F.sqrt(F.count(F.lit(1)))).alias("sem")))


@query("""WITH h AS (SELECT l_linenumber % 3 AS day, l_shipdate AS lag, avg(l_extendedprice) AS w FROM lineitem GROUP BY ALL)
    SELECT a.day AS a, b.day AS b, round(corr(a.w, b.w), 6) AS r, count(*) AS n FROM h a JOIN h b ON a.lag = b.lag AND a.day < b.day GROUP BY ALL""")
def cross_day_correlation(spark, sf_dir):
    """Waveforms of all pairs of days, correlated over lags."""
    h = table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") % 3).alias("a"), F.col("l_shipdate").alias("lag")).agg(F.avg("l_extendedprice").alias("w"))
    o = h.select(F.col("a").alias("b"), "lag", F.col("w").alias("v"))
    return rounded(h.join(o, "lag").where("a < b").groupBy("a", "b").agg(F.corr("w", "v").alias("r"), F.count(F.lit(1)).alias("n")))


@query("""WITH q AS (SELECT l_returnflag, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, sqrt(greatest(0, regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / (count(*) - 2)) AS s, regr_sxx(l_extendedprice, l_quantity) AS sxx, avg(l_quantity) AS mx FROM lineitem GROUP BY 1)
    SELECT l_returnflag, round(slope, 4) AS slope, round(intercept, 3) AS intercept, round(2.069 * s * sqrt(1.0 / n + pow(25 - mx, 2) / sxx), 3) AS band_at_25 FROM q""")
def ols_slope_band(spark, sf_dir):
    """Line fit and the half width of its band at one point."""
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    q = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.regr_sxx(y, x).alias("sxx"), F.avg(x).alias("mx"))
    s = F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy")) / (F.col("n") - 2))
    return q.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round(2.069 * s * F.sqrt(1.0 / F.col("n") + F.pow(25 - F.col("mx"), 2) / F.col("sxx")), 3).alias("band_at_25"))


@query("""WITH m AS (SELECT o_custkey, avg(o_totalprice) AS a FROM orders GROUP BY 1) SELECT c_mktsegment, count(*) AS n, round(corr(c_acctbal, a), 6) AS r,
    round(tanh(atanh(greatest(-0.999999, least(0.999999, corr(c_acctbal, a)))) - 1.959963984540054 / sqrt(count(*) - 3)), 6) AS low, round(tanh(atanh(greatest(-0.999999, least(0.999999, corr(c_acctbal, a)))) + 1.959963984540054 / sqrt(count(*) - 3)), 6) AS high FROM customer JOIN m ON c_custkey = o_custkey GROUP BY 1""")
def behaviour_association(spark, sf_dir):
    """Correlation of two measures joined one to one, with Fisher's interval."""
    from ..operators.relational import one_to_one

    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("a"))
    g = one_to_one(table(spark, sf_dir, "customer"), a, ["c_custkey"]).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.corr("c_acctbal", "a").alias("r"))
    low, high = st.fisher_interval(F.col("r"), F.col("n"))
    return rounded(g.select("c_mktsegment", "n", "r", low.alias("low"), high.alias("high")))


@query()
def permutation_correlation(spark, sf_dir):
    """The behaviour report: correlation of daily counts and means per channel with its interval, permutation p-value and q-value over the channels, in batches of draws over tasks."""
    d = samples(spark, sf_dir).groupBy("channel", "session").agg(F.avg("value").alias("x"), F.count(F.lit(1)).cast("double").alias("y"))
    found = draws.permutations(d, ["channel"], ["session"], "x", "y", 20260101)
    low, high = st.fisher_interval(F.col("r"), F.col("n"))
    return st.benjamini_hochberg(found.select("channel", "n", "r", low.alias("low"), high.alias("high"), "p"), "p", "q")


_HALVES = f"WITH {SAMPLES}, d AS (SELECT channel, subject, avg(value) FILTER (hour < 12) - avg(value) FILTER (hour >= 12) AS d FROM s GROUP BY ALL)"


@query()
def sign_flip_drawn(spark, sf_dir):
    """Sign-flip tests of all subjects' morning and afternoon means per channel: 200 000 drawn patterns, dealt over tasks in batches."""
    half = lambda c: F.avg(F.when(c, F.col("value")))
    d = samples(spark, sf_dir).groupBy("channel", "subject").agg((half(F.col("hour") < 12) - half(F.col("hour") >= 12)).alias("d"))
    return draws.sign_flips(d, ["channel"], ["subject"], "d", 20260102)


@query(_HALVES + """, s1 AS (SELECT channel, count(d) AS n, avg(d) AS mean, stddev_samp(d) AS sd FROM d GROUP BY channel)
    SELECT channel, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd / sqrt(n), 6) AS sem, round(mean / sd, 6) AS dz, round(mean / (sd / sqrt(n)), 6) AS t FROM s1""")
def paired_effect(spark, sf_dir):
    """Paired differences of all subjects: mean, standard error, effect size and t."""
    half = lambda c: F.avg(F.when(c, F.col("value")))
    d = samples(spark, sf_dir).groupBy("channel", "subject").agg((half(F.col("hour") < 12) - half(F.col("hour") >= 12)).alias("d"))
    g = d.groupBy("channel").agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    sem = F.col("sd") / F.sqrt("n")
    return rounded(g.select("channel", "n", "mean", "sd", sem.alias("sem"), (F.col("mean") / F.col("sd")).alias("dz"), (F.col("mean") / sem).alias("t")))


@query("""WITH v AS (SELECT label, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
    SELECT label, CAST(i AS INT) AS i, count(*) AS n, round(avg(x), 6) AS mean, round(CASE WHEN stddev_pop(x) < 1e-8 THEN 1 ELSE stddev_pop(x) END, 6) AS std FROM v GROUP BY label, i""")
def vector_moments(spark, sf_dir):
    """Means and deviations of vectors per label, from states that merge."""
    m = moments.finished_moments(moments.vector_moments(table(spark, sf_dir, "embeddings"), ["label"], "embedding"))
    cells = m.select("label", "n", F.posexplode(F.arrays_zip("mean", "std")).alias("i", "x"))
    return rounded(cells.select("label", "i", "n", F.col("x.mean").alias("mean"), F.col("x.std").alias("std")))

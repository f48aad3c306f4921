"""Linear models, retrieval and signal kernels over the driver's tables."""

from pyspark.sql import functions as F

from ..functions.selection import cut
from ..operators import linear, response, retrieval, signal, windows
from .base import SAMPLES, query, rounded, samples, table

ALPHAS = [1e-6, 1e-4, 1e-2, 1.0, 100.0]

_XY = [("l_quantity", "l_quantity"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_quantity", "l_extendedprice"), ("l_discount", "l_discount"), ("l_discount", "l_tax"), ("l_discount", "l_extendedprice"), ("l_tax", "l_tax"), ("l_tax", "l_extendedprice"), ("l_extendedprice", "l_extendedprice")]
_COLS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


@query(" UNION ALL ".join(f"SELECT l_returnflag, count(*) AS n, {_COLS.index(a)} AS i, {_COLS.index(b)} AS j, round(sum({a} * {b}), 2) AS product FROM lineitem GROUP BY 1" for a, b in _XY))
def gram_matrix(spark, sf_dir):
    """Sums of products per group, in long form."""
    return rounded(linear.gram_rows(table(spark, sf_dir, "lineitem"), ["l_returnflag"], _COLS[:3], "l_extendedprice"), 2)


def _vectors(spark, sf_dir):
    """Vectors as predictors, two noisy targets of them, a story and a role by id."""
    e = table(spark, sf_dir, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double"))
    y = F.array(e["embedding"][0].cast("double") * 2 - e["embedding"][5].cast("double") + F.sin(F.col("vec_id")) / 10, e["embedding"][1].cast("double") + F.cos(F.col("vec_id")) / 10)
    role = F.when(F.col("vec_id") % 5 == 0, "validation").when(F.col("vec_id") % 5 == 1, "test").otherwise("train")
    return e.select("vec_id", F.lit("all").alias("model"), (F.col("vec_id") % 17).cast("int").alias("story"), role.alias("role"), x.alias("x"), y.alias("y"))


@query()
def ridge_path(spark, sf_dir):
    """Mergeable sums per role, one eigendecomposition, alpha by validation error."""
    sums = linear.merged_sums(linear.partial_sums(_vectors(spark, sf_dir), ["model", "role"], "x", "y"), ["model", "role"])
    return linear.fit_paths(sums, ["model"], "role", ALPHAS)


@query()
def ridge_predictions(spark, sf_dir):
    """The model applied to all test rows by dot products; error and correlation by target."""
    v = _vectors(spark, sf_dir)
    model = ridge_path(spark, sf_dir)
    own = F.filter("weights", lambda w, i: i % 2 == F.col("target"))
    model = model.withColumn("target", F.explode(F.array(F.lit(0), F.lit(1)))).select("model", "target", own.alias("w"), F.element_at("intercept", F.col("target") + 1).alias("b"))
    j = v.where("role = 'test'").join(F.broadcast(model), "model")  # two rows
    p = j.select("target", F.element_at("y", F.col("target") + 1).alias("y"), linear.predicted(F.col("x"), F.col("w"), F.col("b")).alias("p"))
    return p.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("y") - F.col("p"), 2)).alias("mse"), F.corr("y", "p").alias("r"))


@query()
def nested_cv(spark, sf_dir):
    """Story-grouped nested cross-validation from sums per story."""
    sums = linear.merged_sums(linear.partial_sums(_vectors(spark, sf_dir), ["model", "story"], "x", "y"), ["model", "story"])
    return linear.grouped_cv(sums, ["model"], "story", ALPHAS)


@query()
def candidate_retrieval(spark, sf_dir):
    """Five-way retrieval of windows: a noisy copy of each trial's vectors against the vectors."""
    e = table(spark, sf_dir, "embeddings")
    y = F.transform("embedding", lambda v: v.cast("double"))
    p = F.transform(y, lambda v, i: v + F.sin(F.col("vec_id") * 3 + i) / 8)
    return retrieval.retrieval_windows(e.select("label", "vec_id", p.alias("p"), y.alias("y")), ["label"], "vec_id", "p", "y", 4, 5, 123)


@query()
def retrieval_summary(spark, sf_dir):
    return retrieval.summary(candidate_retrieval(spark, sf_dir), ["label"], 5)


@query(f"""WITH {SAMPLES}, h AS (SELECT channel, session, hour, avg(value) AS v FROM s GROUP BY ALL), k AS (SELECT channel, session FROM h GROUP BY ALL HAVING count(*) = 24),
    x AS (SELECT h.*, v - avg(v) OVER (PARTITION BY channel, session) AS c FROM h JOIN k USING (channel, session))
    SELECT channel, session, CAST(f AS INT) AS cycles, round(sqrt(pow(sum(c * cos(2 * pi() * f * hour / 24)), 2) + pow(sum(c * sin(2 * pi() * f * hour / 24)), 2)), 5) AS amplitude FROM x, (SELECT unnest([1, 2, 3]) AS f) GROUP BY channel, session, f""")
def daily_harmonics(spark, sf_dir):
    """Amplitudes of the first three harmonics of complete days, as sums of products."""
    h = samples(spark, sf_dir).groupBy("channel", "session", "hour").agg(F.avg("value").alias("v"))
    full = h.groupBy("channel", "session").agg(F.count(F.lit(1)).alias("k"), F.avg("v").alias("m")).where("k = 24")
    x = h.join(full, ["channel", "session"]).withColumn("c", F.col("v") - F.col("m")).withColumn("cycles", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    phase = 2 * F.pi() * F.col("cycles") * F.col("hour") / 24
    return x.groupBy("channel", "session", "cycles").agg(F.round(F.sqrt(F.pow(F.sum(F.col("c") * F.cos(phase)), 2) + F.pow(F.sum(F.col("c") * F.sin(phase)), 2)), 5).alias("amplitude"))


def _series(spark, sf_dir):
    """One series per subject and channel."""
    return windows.numbered(samples(spark, sf_dir).select("subject", "channel", "ts", "event_id", "value"), ["subject", "channel"], ["ts", "event_id"])


@query()
def fft_resample(spark, sf_dir):
    return signal.on_series(_series(spark, sf_dir), ["subject", "channel"], "t", "value", lambda x: signal.resample_fft(x, max(1, len(x) // 2)), stacked=True)


@query()
def poly_resample(spark, sf_dir):
    return signal.on_series(_series(spark, sf_dir), ["subject", "channel"], "t", "value", lambda x: signal.resample_poly(x, 64, 125), stacked=True)


@query()
def lowpass(spark, sf_dir):
    """Zero-phase eighth-order low-pass."""
    sos = signal.butter_sos(8, 0.4)
    return signal.on_series(_series(spark, sf_dir), ["subject", "channel"], "t", "value", lambda x: signal.filtfilt(sos, x), stacked=True)


@query()
def log_mel_frames(spark, sf_dir):
    """Mean log-mel energy of each series read as a waveform."""
    return signal.on_series(_series(spark, sf_dir), ["subject", "channel"], "t", "value", lambda x: signal.log_mel(x.T, max(1, len(x) // 160 + 1)).mean(-1).T, stacked=True)


def _psd(spark, sf_dir):
    return signal.spectra(_series(spark, sf_dir), ["subject", "channel"], "t", "value", 100.0, 64)


@query()
def welch_psd(spark, sf_dir):
    return _psd(spark, sf_dir)


@query()
def spectral_measures(spark, sf_dir):
    """Band means, band power, spectral slope and line noise per channel, in SQL over the spectra."""
    psd = cut(_psd(spark, sf_dir).groupBy("channel", "frequency").agg(F.avg("power").alias("power")), "spectra")  # small, and read four times
    out = signal.band_means(psd, ["channel"]).join(signal.band_power(psd, ["channel"], 1.0, 40.0, "broadband"), "channel")
    return out.join(psd.groupBy("channel").agg(signal.spectral_slope().alias("slope"), signal.line_noise_db((28.0, 32.0), ((22.0, 26.0), (34.0, 38.0))).alias("line_db")), "channel")


@query()
def artifact_rate(spark, sf_dir):
    """Peaks of robust z per series."""
    return signal.event_rate(_series(spark, sf_dir), ["subject", "channel"], "t", "value", 3.0, 2)


@query()
def trial_splits(spark, sf_dir):
    """Each subject's trials dealt to train, validation and test, by a draw that depends on seed, subject and group only."""
    import pandas as pd

    t = samples(spark, sf_dir).select("subject", F.dayofmonth("ts").alias("trial")).distinct()
    enough = t.groupBy("subject").count().where("count > 4").select("subject")  # others have no trial left to train on
    t = t.join(enough, "subject", "left_semi")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        roles = retrieval.split(pdf["trial"].tolist(), 42, int(key[0]), 1)
        return pd.DataFrame([(key[0], k, r) for k, r in roles.items()], columns=["subject", "trial", "role"])

    return t.groupBy("subject").applyInPandas(run, "subject long, trial int, role string")


_FOLD = "".join(
    f", f{k} AS (SELECT l_suppkey, l_linenumber, weight, r, a, b, c, CASE WHEN r <> {k} THEN fold WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS fold FROM (SELECT *, sum(CASE WHEN fold = 0 THEN weight ELSE 0 END) OVER (PARTITION BY l_suppkey) AS a, sum(CASE WHEN fold = 1 THEN weight ELSE 0 END) OVER (PARTITION BY l_suppkey) AS b, sum(CASE WHEN fold = 2 THEN weight ELSE 0 END) OVER (PARTITION BY l_suppkey) AS c FROM (SELECT l_suppkey, l_linenumber, weight, r, fold FROM f{k - 1})))"
    for k in range(1, 8)
)  # one step for each of the seven line numbers


@query(f"""WITH w AS (SELECT l_suppkey, l_linenumber, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL), f0 AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY weight DESC, l_linenumber) AS r, CAST(NULL AS INT) AS fold FROM w){_FOLD}
    SELECT l_suppkey, l_linenumber, fold FROM f7""")
def balanced_folds(spark, sf_dir):
    """Suppliers' parts dealt to three folds of near equal weight, longest first."""
    import pandas as pd

    w = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.sum("l_quantity").alias("weight"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        folds = linear.balanced_folds(pdf["l_linenumber"].tolist(), pdf["weight"].tolist(), 3)
        return pd.DataFrame([(key[0], i, f) for i, f in folds.items()], columns=["l_suppkey", "l_linenumber", "fold"])

    return w.groupBy("l_suppkey").applyInPandas(run, "l_suppkey long, l_linenumber int, fold int")


_FIRST, _LAGS, _SIZE = -1, 4, 4096


def _response_chunks(spark, sf_dir):
    """A day's events in order are a stimulus; two subjects answer each of them in two channels."""
    s = windows.numbered(samples(spark, sf_dir), ["session"], ["ts", "event_id"])
    x = s.select(F.substring("session", 1, 7).alias("month"), "session", F.col("t").cast("long").alias("t"), "value")
    who = F.explode(F.array(F.lit(1), F.lit(2))).alias("subject")
    y = s.select(F.substring("session", 1, 7).alias("month"), "session", F.col("t").cast("long").alias("t"), F.col("subject").alias("user_id"), "hour", "value", who)
    y = y.select("subject", "month", "session", "t", F.array(F.col("user_id") + F.col("subject") * F.col("value"), F.col("value") * F.col("value") / 100 - F.col("subject") * F.col("hour")).alias("y"))
    return response.stimulus_chunks(x, ["month", "session"], "t", "value", _LAGS, _SIZE), y


def _response_sums(spark, sf_dir):
    story = ["month", "session"]
    chunks, y = _response_chunks(spark, sf_dir)
    designs = response.lag_products(chunks, story, _LAGS, _SIZE)
    return designs, response.standardised(response.cross_products(y, chunks, ["subject"], story, "t", "y", _FIRST, _LAGS, _SIZE), designs, story, _LAGS)


_LAGGED = f"""WITH {SAMPLES}, n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS k FROM s),
    l AS (SELECT session, subject AS u, hour, value, lead(value, 1) OVER w AS x0, value AS x1, lag(value, 1) OVER w AS x2, lag(value, 2) OVER w AS x3 FROM n WINDOW w AS (PARTITION BY session ORDER BY k)),
    v AS (SELECT * FROM l WHERE x0 IS NOT NULL AND x3 IS NOT NULL)"""


@query(_LAGGED + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT session, {i} AS i, {j} AS j, count(*) AS n, round(count(*) * corr(x{i}, x{j}), 4) AS product FROM v GROUP BY session" for i in range(4) for j in range(4)) + ")")
def response_design(spark, sf_dir):
    """X'X of a standardised lagged design per day, from lag sums and edges."""
    designs, _ = _response_sums(spark, sf_dir)
    cells = designs.select("session", "n", F.posexplode("xx").alias("at", "product"))
    return cells.select("session", F.expr(f"at div {_LAGS}").cast("int").alias("i"), (F.col("at") % _LAGS).cast("int").alias("j"), "n", F.round("product", 4).alias("product"))


@query(_LAGGED + ", r AS (SELECT *, unnest([1, 2]) AS subject FROM v) SELECT * FROM (" + " UNION ALL ".join(f"SELECT CAST(subject AS INT) AS subject, session, {j} AS lag, {c} AS channel, round(count(*) * corr(x{j}, {y}), 4) AS product FROM r GROUP BY subject, session" for j in range(4) for c, y in enumerate(["u + subject * value", "value * value / 100 - subject * hour"])) + ")")
def response_products(spark, sf_dir):
    """X'Y of standardised responses: each subject's, against the design that all of them share."""
    _, sums = _response_sums(spark, sf_dir)
    cells = sums.select("subject", "session", F.posexplode("xy").alias("at", "product"))
    return cells.select("subject", "session", F.expr("at div 2").cast("int").alias("lag"), (F.col("at") % 2).cast("int").alias("channel"), F.round("product", 4).alias("product"))


@query()
def trf_correlation(spark, sf_dir):
    """A lagged response model per subject and month, judged by nested cross-validation over days; operators are made once a month for all subjects."""
    designs, sums = _response_sums(spark, sf_dir)
    plans = response.fold_plans(designs, ["month"], "session", 5, ALPHAS)
    return response.pooled(response.cross_validated(sums, plans, ["subject"], ["month"], "session", ALPHAS), ["subject", "month"])


@query()
def response_waveform(spark, sf_dir):
    """The response function over lags: alpha by cross-validation, refitted on all days, z over lags, mean over channels."""
    designs, sums = _response_sums(spark, sf_dir)
    return linear.response_waveform(response.as_sums(sums, designs, ["month", "session"]), ["subject", "month"], "session", ALPHAS)

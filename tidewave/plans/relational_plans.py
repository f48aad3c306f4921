"""Joins, interval operators, set operations and reshaping over the driver's tables."""

from pyspark.sql import functions as F

from ..functions import missing, names
from ..operators import intervals, relational, windows
from .base import SAMPLES, query, rounded, samples, table


@query("""WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS spent FROM orders GROUP BY 1) SELECT c_custkey, c_name, round(spent, 2) AS spent FROM customer JOIN a ON c_custkey = k""")
def one_to_one_join(spark, sf_dir):
    """Inner join whose keys must be unique on both sides."""
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return relational.one_to_one(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), spent, ["c_custkey"])


@query("""WITH q AS (SELECT l_suppkey AS s_suppkey, count(*) AS n, round(avg(l_discount), 6) AS s_acctbal FROM lineitem WHERE l_quantity > 45 GROUP BY 1) SELECT s_suppkey, s_name, s_nationkey, q.s_acctbal, n FROM supplier LEFT JOIN q USING (s_suppkey)""")
def left_replace_join(spark, sf_dir):
    """Left join after dropping clashing columns."""
    q = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("s_acctbal"))
    return relational.left_replacing(table(spark, sf_dir, "supplier"), q, ["s_suppkey"])


@query("""WITH l AS (SELECT l_orderkey, l_returnflag, count(*) AS n, max(l_tax) AS top FROM lineitem GROUP BY ALL)
    SELECT a.l_orderkey, a.n AS n_raw, a.top AS top_raw, b.n AS n_returned, b.top AS top_returned FROM l a JOIN l b USING (l_orderkey) WHERE a.l_returnflag = 'N' AND b.l_returnflag = 'R'""")
def suffixed_join(spark, sf_dir):
    """Inner join of two filtered sides, clashing columns suffixed."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.max("l_tax").alias("top"))
    side = lambda f: g.where(F.col("l_returnflag") == f).drop("l_returnflag")
    return relational.suffixed(side("N"), side("R"), ["l_orderkey"], ("_raw", "_returned"))


@query("""SELECT n_name, r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON upper(regexp_replace(upper(n_name), '[^A-Z0-9]', '', 'g')) = 'NATION' || c_nationkey GROUP BY ALL""")
def normalized_name_join(spark, sf_dir):
    """Join on channel names normalised to letters and digits."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("nation "), "c_nationkey").alias("label"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return relational.on_normalized(n, c, "n_name", "label", names.letters_upper).groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"))


_SPANS = "i AS (SELECT user_id AS subject, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS trial, epoch(ts) AS start, epoch(ts) + 7200 AS stop FROM events WHERE event_type = 'signup')"


def _spans(spark, sf_dir):
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(F.col("user_id").alias("subject"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("trial"), at.alias("start"), (at + 7200).alias("stop"))


@query(f"""WITH {_SPANS}, p AS (SELECT event_id, user_id AS subject, epoch(ts) AS tm FROM events WHERE event_type <> 'signup'),
    m AS (SELECT event_id, min(trial) AS trial FROM p JOIN i USING (subject) WHERE tm >= start AND tm < stop GROUP BY event_id) SELECT event_id, CAST(trial AS INT) AS trial FROM p LEFT JOIN m USING (event_id)""")
def interval_first_match(spark, sf_dir):
    """Each event with the first two-hour trial of its subject that holds it, by a bucketed range join."""
    p = table(spark, sf_dir, "events").where("event_type <> 'signup'").select("event_id", F.col("user_id").alias("subject"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return intervals.first_match(p, _spans(spark, sf_dir), ["event_id"], "at", "start", "stop", ["trial"], 7200, ["subject"]).select("event_id", "trial")


@query(f"""WITH {_SPANS} SELECT a.subject, CAST(a.trial AS INT) AS trial, count(*) AS others FROM i a JOIN i b ON a.subject = b.subject AND a.trial <> b.trial AND a.start < b.stop AND b.start < a.stop GROUP BY ALL""")
def overlapping_spans(spark, sf_dir):
    """How many trials of a subject overlap each trial."""
    s = _spans(spark, sf_dir)
    o = s.select("subject", F.col("trial").alias("t2"), F.col("start").alias("s2"), F.col("stop").alias("e2"))
    return intervals.overlapping(s, o, "start", "stop", "s2", "e2", 7200, ["subject"]).where("trial <> t2").groupBy("subject", "trial").agg(F.count(F.lit(1)).alias("others"))


_WORDS = """w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS k FROM documents),
    z AS (SELECT doc_id, word, k, sum(length(word)) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS e FROM w)"""


def _words(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(F.split("text", " ")).alias("k", "word"))
    start = windows.running_length(["doc_id"], ["k"], F.col("word"))
    return d.withColumn("start", start).withColumn("stop", start + F.length("word")).withColumn("k", F.col("k") + 1)


@query(f"WITH {_WORDS}, f AS (SELECT doc_id, k, CAST(round_even((e - length(word)) * 0.3, 0) AS BIGINT) AS lo, CAST(round_even(e * 0.3, 0) AS BIGINT) AS hi FROM z),"
    " x AS (SELECT doc_id, k, unnest(range(lo, hi)) AS frame FROM f WHERE hi > lo), g AS (SELECT doc_id, frame, max(k) AS k FROM x GROUP BY ALL) SELECT doc_id, count(*) AS frames, CAST(sum(k) AS BIGINT) AS checksum, max(frame) AS last FROM g GROUP BY doc_id".replace("* 0.3", "* CAST(0.3 AS DOUBLE)"))
def interval_rasterize(spark, sf_dir):
    """Words rasterised on frames (bounds rounded half to even, last writer wins), summed up by document."""
    g = intervals.rasterize(_words(spark, sf_dir), "start", "stop", 0.3, "k", ["k"], ["doc_id"])
    return g.groupBy("doc_id").agg(F.count(F.lit(1)).alias("frames"), F.sum("k").alias("checksum"), F.max("frame").alias("last"))


@query(f"""WITH {_WORDS}, t AS (SELECT doc_id, k AS tk, e - length(word) AS at FROM z), s AS (SELECT doc_id, k, e - length(word) AS start FROM z WHERE length(word) > 3)
    SELECT t.doc_id, count(*) AS tokens, count(s.k) AS matched, CAST(coalesce(sum(s.k), 0) AS BIGINT) AS checksum FROM t ASOF LEFT JOIN (SELECT doc_id, start, max(k) AS k FROM s GROUP BY ALL) s ON t.doc_id = s.doc_id AND t.at >= s.start GROUP BY t.doc_id""")
def asof_token_word(spark, sf_dir):
    """Each word's start looked up among the longer words: the last one at or before it."""
    w = _words(spark, sf_dir)
    t = w.select("doc_id", F.col("k").alias("tk"), F.col("start").alias("at"))
    s = w.where("length(word) > 3").groupBy("doc_id", "start").agg(F.max("k").alias("k"))
    out = intervals.latest_before(t, s, ["doc_id"], "at", "start", ["k"])
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"), F.count("k").alias("matched"), F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("checksum"))


@query("""WITH m AS (SELECT user_id, event_type, event_id, epoch(ts) AS tm FROM events), p AS (SELECT *, lag(tm) OVER w AS s, row_number() OVER w AS n FROM m WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id))
    SELECT user_id, event_type, round(max_by(s, n), 3) AS start, round(max_by(tm, n), 3) AS stop, count(*) AS candidate_pair_count FROM p WHERE tm - s >= 3600 GROUP BY ALL""")
def adjacent_pairs_last(spark, sf_dir):
    """Neighbouring markers at least an hour apart, in file order; the last pair of each kind."""
    m = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return rounded(intervals.adjacent_pairs(m, ["user_id", "event_type"], ["event_id"], "at", 3600), 3)


@query("""WITH m AS (SELECT user_id, event_type, epoch(ts) AS at, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events),
    p AS (SELECT a.user_id, a.event_type, a.i, b.i AS j, a.at AS s, b.at AS e, abs(b.at - (a.at + 86400)) AS err FROM m a JOIN m b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.i < b.i)
    SELECT user_id, event_type, round(min_by(s, (err, i, j)), 3) AS start, round(min_by(e, (err, i, j)), 3) AS stop, round(min(err), 3) AS error FROM p GROUP BY ALL""")
def best_pair_by_duration(spark, sf_dir):
    """Of all marker pairs of a kind, the one whose gap is nearest to a day."""
    m = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return rounded(intervals.best_pair(m, ["user_id", "event_type"], ["event_id"], "at", F.lit(86400.0)), 3)


@query("""WITH g AS (SELECT * FROM (SELECT DISTINCT n_nationkey FROM nation), (SELECT DISTINCT c_mktsegment FROM customer), (SELECT DISTINCT o_orderpriority FROM orders)),
    f AS (SELECT DISTINCT c_nationkey AS n_nationkey, c_mktsegment, o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 400000)
    SELECT g.*, f.n_nationkey IS NOT NULL AS present FROM g LEFT JOIN f ON g.n_nationkey = f.n_nationkey AND g.c_mktsegment = f.c_mktsegment AND g.o_orderpriority = f.o_orderpriority""")
def completeness_grid(spark, sf_dir):
    """The design's grid and which cells have large orders."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    found = c.join(o.where("o_totalprice > 400000"), c["c_custkey"] == o["o_custkey"]).withColumn("n_nationkey", F.col("c_nationkey"))
    dims = [table(spark, sf_dir, "nation").select("n_nationkey").distinct(), c.select("c_mktsegment").distinct(), o.select("o_orderpriority").distinct()]
    return relational.coverage(dims, found, ["n_nationkey", "c_mktsegment", "o_orderpriority"])


@query("""SELECT p_partkey AS k, 'missing' AS side FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 3) UNION ALL
    SELECT DISTINCT l_partkey, 'extra' FROM lineitem WHERE l_quantity < 3 AND l_partkey NOT IN (SELECT p_partkey FROM part)""")
def missing_extra(spark, sf_dir):
    """Expected keys without rows, and rows without expected keys."""
    found = table(spark, sf_dir, "lineitem").where("l_quantity < 3").select(F.col("l_partkey").alias("k"))
    return relational.difference(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), found, ["k"])


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS med, round(stddev_samp(l_quantity), 6) AS std, min(l_tax) AS low, max(l_tax) AS high, count(DISTINCT l_suppkey) AS suppliers,
    round(exp(avg(ln(l_extendedprice))), 4) AS geometric, round(100 * avg(CAST(l_discount > 0.05 AS INT)), 6) AS percent, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS weighted FROM lineitem GROUP BY ALL""")
def mixed_aggregates(spark, sf_dir):
    """Counts, sums, means, medians, deviations, distinct counts, geometric and weighted means, percentages."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.round(F.median("l_extendedprice"), 4).alias("med"),
        F.round(F.stddev_samp("l_quantity"), 6).alias("std"), F.min("l_tax").alias("low"), F.max("l_tax").alias("high"), F.countDistinct("l_suppkey").alias("suppliers"),
        F.round(F.exp(F.avg(F.log("l_extendedprice"))), 4).alias("geometric"), F.round(100 * F.avg((F.col("l_discount") > 0.05).cast("int")), 6).alias("percent"),
        F.round(F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity"), 6).alias("weighted"))


@query("""SELECT coalesce(CAST(l_linenumber AS VARCHAR), 'all') AS day, count(*) AS n, round(avg(l_discount), 7) AS mean FROM lineitem GROUP BY ROLLUP (l_linenumber)""")
def rollup_with_all(spark, sf_dir):
    """Groups by day and the row of all."""
    out = table(spark, sf_dir, "lineitem").rollup("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 7).alias("mean"))
    return out.select(F.coalesce(F.col("l_linenumber").cast("string"), F.lit("all")).alias("day"), "n", "mean")


@query("""SELECT event_type, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1""")
def value_counts(spark, sf_dir):
    return relational.duplicates(table(spark, sf_dir, "events"), ["event_type"])


@query("""SELECT p_brand, round(avg(CAST(l_returnflag = 'R' AS INT)), 6) AS rate, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY round(avg(CAST(l_returnflag = 'R' AS INT)), 6) DESC, 1 LIMIT 10""")
def top_k_flag_rate(spark, sf_dir):
    """The ten brands with the highest share of returns; the limit is the report's."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rate = l.join(p, l["l_partkey"] == p["p_partkey"]).groupBy("p_brand").agg(F.round(F.avg((F.col("l_returnflag") == "R").cast("int")), 6).alias("rate"), F.count(F.lit(1)).alias("n"))
    return rate.orderBy(F.desc("rate"), "p_brand").limit(10)


@query("""WITH d(event_type, position) AS (VALUES ('view', 0), ('click', 1), ('absent', 2), ('error', 3)) SELECT d.event_type, position, n FROM d LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) USING (event_type)""")
def reordered_domain(spark, sf_dir):
    """Counts in a fixed order of kinds, nulls for those not there."""
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return relational.reordered(g, "event_type", ["view", "click", "absent", "error"])


@query("""SELECT l_suppkey, coalesce(max(l_quantity) FILTER (l_returnflag = 'A'), 0) AS "A", coalesce(max(l_quantity) FILTER (l_returnflag = 'N'), 0) AS "N", coalesce(max(l_quantity) FILTER (l_returnflag = 'R'), 0) AS "R" FROM lineitem GROUP BY 1""")
def pivot_max_filled(spark, sf_dir):
    return relational.pivoted(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag", ["A", "N", "R"], F.max("l_quantity"), 0.0)


@query("""SELECT o_orderkey, 'price' AS measure, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, 'year', CAST(year(o_orderdate) AS DOUBLE) FROM orders""")
def melt_conditions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.year("o_orderdate").cast("double").alias("year"))
    return relational.melted(o, ["o_orderkey"], ["price", "year"], "measure", "value")


@query("""SELECT c_custkey AS k, c_name AS name, c_acctbal AS balance, 'customer' AS kind, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, 'supplier', NULL FROM supplier""")
def union_missing_cols(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("kind"))
    return relational.stacked([c, s])


@query("""WITH f AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice < 5000), l AS (SELECT l_orderkey, count(*) AS n, max(l_tax) AS top FROM lineitem GROUP BY 1), c AS (SELECT o_custkey, count(*) AS orders_of FROM orders GROUP BY 1)
    SELECT f.o_orderkey, f.o_custkey, n, top, orders_of FROM f LEFT JOIN l ON o_orderkey = l_orderkey LEFT JOIN c USING (o_custkey)""")
def flagged_with_lookups(spark, sf_dir):
    """Flagged rows with aggregates of two other tables, each aggregated once."""
    from ..operators.quality import with_counts_of

    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    flagged = o.where("o_totalprice < 5000").select("o_orderkey", "o_custkey")
    flagged = with_counts_of(flagged, [(l, [F.count(F.lit(1)).alias("n"), F.max("l_tax").alias("top")])], ["o_orderkey"])
    return with_counts_of(flagged, [(o, [F.count(F.lit(1)).alias("orders_of")])], ["o_custkey"])


@query("""SELECT doc_id, sha256(text) AS sha, length(text) AS n, length(regexp_replace(text, '[^一-鿿]', '', 'g')) AS cjk, upper(trim(lang)) AS lang FROM documents""")
def text_profile(spark, sf_dir):
    """Digest, length and CJK count of transcripts."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.length("text").cast("long").alias("n"), names.cjk_count(F.col("text")).cast("long").alias("cjk"), names.stripped_upper(F.col("lang")).alias("lang"))


@query("""SELECT o_orderkey, TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS level, CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS INT) AS number, 'day' || (1 + o_orderkey % 3) AS day, regexp_matches(o_orderpriority, '^(1|2)') AS urgent FROM orders JOIN customer ON o_custkey = c_custkey""")
def parsed_names(spark, sf_dir):
    """Tolerant casts, trailing numbers, label rewriting and prefix tests."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    return j.select("o_orderkey", missing.number(F.split("o_orderpriority", "-")[0]).alias("level"), names.trailing_number(F.col("c_name")).alias("number"), F.regexp_replace(F.concat(F.lit("ses-day"), (1 + F.col("o_orderkey") % 3).cast("string")), "^ses-", "").alias("day"), F.col("o_orderpriority").rlike("^(1|2)").alias("urgent"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, CASE WHEN event_id % 50 + 1 <= 17 THEN 1 WHEN event_id % 50 + 1 <= 33 THEN 2 ELSE 3 END AS day, CASE WHEN event_id % 50 + 1 <= 33 THEN 'early' ELSE 'late' END AS device FROM events""")
def story_labels(spark, sf_dir):
    """Day and device of a story, and a field of a JSON cell."""
    story = (F.col("event_id") % 50 + 1).cast("int")
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), names.story_day(story).alias("day"), names.story_device(story).alias("device"))


@query("""SELECT o_orderkey, to_json(list(l_tax ORDER BY l_linenumber, l_partkey, l_suppkey, l_tax)) AS cell, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 300000 GROUP BY 1""")
def json_cells(spark, sf_dir):
    """Arrays written to JSON cells in a fixed order."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    g = l.join(o.where("o_totalprice > 300000"), l["l_orderkey"] == o["o_orderkey"]).groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_tax"))).alias("a"), F.count(F.lit(1)).alias("n"))
    return g.select("o_orderkey", F.to_json(F.transform("a", lambda x: x["l_tax"])).alias("cell"), "n")


@query(f"""WITH {SAMPLES}, a AS (SELECT subject, session, max(epoch(ts)) - min(epoch(ts)) AS expected, count(*) AS n FROM s GROUP BY ALL)
    SELECT subject, session, n, round(expected, 3) AS expected, CASE WHEN abs(expected - 86400) <= 43200 THEN 'ok' WHEN expected < 1 THEN 'missing' ELSE 'short' END AS status FROM a""")
def duration_consistency(spark, sf_dir):
    """Recorded spans against a nominal day, with a status."""
    s = samples(spark, sf_dir).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    a = s.groupBy("subject", "session").agg((F.max("at") - F.min("at")).alias("expected"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.abs(F.col("expected") - 86400) <= 43200, "ok").when(F.col("expected") < 1, "missing").otherwise("short")
    return a.select("subject", "session", "n", F.round("expected", 3).alias("expected"), status.alias("status"))


@query("""WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, list_transform(embedding, lambda x: CAST(CAST(x * 10000 AS BIGINT) AS DOUBLE) / 10000) AS w FROM embeddings)
    SELECT vec_id, len(v) = len(w) AS same_shape, round(list_max(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - w[i]))), 6) AS max_abs FROM a""")
def array_comparison(spark, sf_dir):
    """Arrays against a rounded copy: shape and largest difference."""
    from ..operators.audit import compare_arrays

    e = table(spark, sf_dir, "embeddings").withColumn("w", F.transform("embedding", lambda x: F.rint((x * F.lit(10000.0).cast("float")).cast("double")) / 10000))
    return compare_arrays(e, "embedding", "w").select("vec_id", "same_shape", F.round("max_abs", 6).alias("max_abs"))


@query("""SELECT 'documents' AS name, count(*) AS n, count(DISTINCT doc_id) AS keys, count(*) FILTER (text IS NULL) AS nulls, min(length(text)) AS low, max(length(text)) AS high FROM documents UNION ALL
    SELECT 'pages', count(*), count(DISTINCT page_id), count(*) FILTER (html IS NULL), min(length(html)), max(length(html)) FROM pages UNION ALL
    SELECT 'conversations', count(*), count(DISTINCT conv_id), count(*) FILTER (text IS NULL), min(length(text)), max(length(text)) FROM conversations""")
def inventory(spark, sf_dir):
    """Counts, keys, missing values and extremes of several inputs."""
    from ..operators.audit import profile

    parts = [profile(table(spark, sf_dir, t), t, k, c) for t, k, c in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id", "text"))]
    return relational.stacked(parts)


@query("SELECT l_orderkey, l_linenumber, p_brand, p_size FROM lineitem JOIN part ON l_partkey = p_partkey")
def lexicon_lookup(spark, sf_dir):
    """Every row with its lexicon entry; a key without one would fail the query."""
    words = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    return relational.lookup(table(spark, sf_dir, "lineitem"), words, "l_partkey").select("l_orderkey", "l_linenumber", "p_brand", "p_size")


@query("SELECT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def common_channels(spark, sf_dir):
    """Ids that all of several tables have."""
    l, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    of = lambda flag: l.where(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("id"))
    return relational.intersection([of("A"), of("R"), s.where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))], ["id"])


@query("""WITH w AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1),
    m AS (UNPIVOT w ON f, o, p INTO NAME status VALUE wide), n AS (SELECT o_custkey, lower(o_orderstatus) AS status, count(*) AS long FROM orders WHERE o_totalprice > 1000 GROUP BY ALL)
    SELECT coalesce(m.o_custkey, n.o_custkey) AS o_custkey, coalesce(m.status, n.status) AS status, CAST(wide AS DOUBLE) AS wide, CAST(long AS DOUBLE) AS long FROM m FULL JOIN n ON m.o_custkey = n.o_custkey AND m.status = n.status WHERE NOT coalesce((wide IS NULL AND long IS NULL) OR abs(wide - long) <= 0, false)""")
def wide_long_differences(spark, sf_dir):
    """Cells in which a wide table of counts and its long form differ, or that one of them lacks."""
    orders = table(spark, sf_dir, "orders")
    count = lambda s: F.count(F.when(F.col("o_orderstatus") == s.upper(), 1)).cast("double").alias(s)
    wide = orders.groupBy("o_custkey").agg(*map(count, "fop"))
    long = orders.where("o_totalprice > 1000").groupBy("o_custkey", F.lower("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return relational.same_values(wide, long, ["o_custkey"], list("fop"), "status", "n")

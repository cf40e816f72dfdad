"""Summaries: patients are customers, recordings orders, events line items; or users and their events."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatlake.functions import scalars as C
from beatlake.operators import summaries as U
from beatlake.plans.registry import E, events_table, query, rounded, table

USER = ["user_id"]
TYPES = ["click", "error", "purchase", "signup", "view"]
PIVOT = ", ".join(f"round(avg(value) FILTER (WHERE event_type = '{t}'), 8) AS {t}" for t in TYPES)


@query("patient_summary", """WITH r AS (SELECT o_custkey AS patient_id, count(DISTINCT o_orderkey) AS n_recordings, sum(o_totalprice) / 3600 AS hours FROM orders GROUP BY 1), e AS (SELECT o_custkey AS patient_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1)
SELECT patient_id, n_recordings, round(hours, 6) AS hours, coalesce(n, 0) AS n_events, round(hours / nullif(n, 0), 9) AS hours_per_event FROM r LEFT JOIN e USING (patient_id)""")
def patient_summary(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    r = o.select(F.col("o_custkey").alias("patient_id"), "o_orderkey", "o_totalprice")
    e = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("patient_id"))
    return rounded(U.patient_summary(r, e, "patient_id", "o_orderkey", "o_totalprice").withColumn("hours_per_event", F.round("hours_per_event", 9)), "hours")


@query("dataset_overview", """WITH a AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT o_custkey)::DOUBLE AS p, round(sum(o_totalprice), 2) AS s, round(median(o_totalprice), 3) AS m, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 3) AS q FROM orders)
SELECT unnest(['n_recordings', 'n_patients', 'total', 'median', 'iqr']) AS metric, unnest([n, p, s, m, q]) AS value FROM a""")
def dataset_overview(spark, sf_dir):
    v = F.col("o_totalprice")
    x = U.overview(table(spark, sf_dir, "orders"), {"n_recordings": F.count("*"), "n_patients": F.countDistinct("o_custkey"), "total": F.sum(v)}, {"p25": (v, 0.25), "median": (v, 0.5), "p75": (v, 0.75)})
    iqr = x.where("metric in ('p25', 'p75')").agg(F.sum(F.when(F.col("metric") == "p75", F.col("value")).otherwise(-F.col("value"))).alias("value"))
    x = x.where("metric not in ('p25', 'p75')").unionByName(iqr.select(F.lit("iqr").alias("metric"), "value"))
    return x.withColumn("value", F.when(F.col("metric") == "total", F.round("value", 2)).otherwise(F.round("value", 3)))


@query("stability_quantiles", f"WITH {E} SELECT event_type, count(value) AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS min, round(quantile_cont(value, 0.05), 4) AS p050, round(median(value), 4) AS p500, round(quantile_cont(value, 0.95), 4) AS p950, round(quantile_cont(value, 0.99), 4) AS p990, max(value) AS max FROM e GROUP BY 1")
def stability_quantiles(spark, sf_dir):
    x = U.describe(events_table(spark, sf_dir), ["event_type"], "value", [0.05, 0.5, 0.95, 0.99])
    return rounded(x, "mean", "std", "p050", "p500", "p950", "p990", digits=4)


@query("group_summary", f"WITH {E} SELECT event_type, round(avg(value), 4) AS value_mean, round(stddev_samp(value), 4) AS value_std, round(median(value), 4) AS value_median, count(value) AS value_count, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS place FROM e GROUP BY 1")
def group_summary(spark, sf_dir):
    x = U.group_summary(events_table(spark, sf_dir), ["event_type"], ["value"]).withColumn("place", U.rank_of("event_type", ["view", "click", "purchase"]).cast("int"))
    return rounded(x, "value_mean", "value_std", "value_median", digits=4)


@query("value_counts", "SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS p, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def value_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("p"), "o_orderstatus")
    return U.value_counts(o, "p", "o_orderstatus")


@query("crosstab", f"WITH {E} SELECT value > 10 AS high, count(*) FILTER (WHERE event_type = 'error') AS n_true, count(*) FILTER (WHERE event_type <> 'error') AS n_false FROM e GROUP BY 1")
def crosstab(spark, sf_dir):
    x = events_table(spark, sf_dir).select((F.col("value") > 10).alias("high"), (F.col("event_type") == "error").alias("err"))
    return U.crosstab(x, "high", "err", [True, False]).select("high", "n_true", "n_false")


@query("pivot_roles", f"WITH {E} SELECT user_id, {PIVOT} FROM e GROUP BY 1")
def pivot_roles(spark, sf_dir):
    return rounded(U.pivot_mean(events_table(spark, sf_dir), USER, "event_type", "value", TYPES), *TYPES, digits=8)


@query("unstack_stack", f"WITH {E} SELECT user_id, event_type AS name, round(median(value), 4) AS value FROM e GROUP BY 1, 2 UNION ALL SELECT u.user_id, t.n, NULL FROM (SELECT DISTINCT user_id FROM e) u, (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) t(n) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = u.user_id AND e.event_type = t.n)")
def unstack_stack(spark, sf_dir):
    x = U.unstack_median(events_table(spark, sf_dir), USER, "event_type", "value", TYPES)
    return rounded(U.stack(x, USER, TYPES), "value", digits=4)


@query("paired_delta", f"WITH {E}, p AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'view') AS b, avg(value) FILTER (WHERE event_type = 'click') AS c, avg(value) FILTER (WHERE event_type = 'error') AS r FROM e GROUP BY 1) SELECT user_id, 'click' AS method, round(c - b, 8) AS delta FROM p WHERE c IS NOT NULL AND b IS NOT NULL UNION ALL SELECT user_id, 'error', round(r - b, 8) FROM p WHERE r IS NOT NULL AND b IS NOT NULL")
def paired_delta(spark, sf_dir):
    return rounded(U.paired_delta(events_table(spark, sf_dir), USER, "event_type", "value", "view", ["click", "error"]), "delta", digits=8)


@query("correlation_matrix", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem")
def correlation_matrix(spark, sf_dir):
    return rounded(U.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), "r")


@query("hour_histogram", f"WITH {E}, h AS (SELECT event_type, floor((t % 86400) / 3600)::INT AS bin, count(*) AS n FROM e GROUP BY 1, 2) SELECT event_type, bin, n, round(100.0 * n / sum(n) OVER (PARTITION BY event_type), 6) AS percent FROM h")
def hour_histogram(spark, sf_dir):
    return rounded(U.histogram(events_table(spark, sf_dir), ["event_type"], (F.col("t") % 86400) / 3600, 24, 0.0, 24.0), "percent")


@query("day_night", "SELECT event_type, count(*) FILTER (WHERE hour(ts) >= 22 OR hour(ts) < 6) AS night, count(*) FILTER (WHERE hour(ts) >= 22 OR hour(ts) < 7) AS night7, count(*) AS n, sum(hour(ts) * 3600 + minute(ts) * 60 + second(ts)) AS seconds FROM events GROUP BY 1")
def day_night(spark, sf_dir):
    ts = F.col("ts")
    n = lambda c: F.count(F.when(c, 1))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(n(C.is_night(ts)).alias("night"), n(C.is_night(ts, end=7)).alias("night7"), F.count("*").alias("n"), F.sum(C.seconds_since_midnight(ts)).alias("seconds"))


@query("zero_filled_counts", "SELECT n_nationkey, n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1, 2")
def zero_filled_counts(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").withColumnRenamed("s_nationkey", "n_nationkey")
    return U.spine_counts(s, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])


@query("class_summary", f"WITH {E}, s AS (SELECT DISTINCT user_id FROM e), c AS (SELECT user_id, v.y FROM s, (VALUES ('click'), ('error'), ('none')) v(y)), g AS (SELECT user_id, event_type AS y, median(value) AS m, count(*) AS n FROM e GROUP BY 1, 2) SELECT user_id, y AS event_type, round(m, 4) AS value, coalesce(n, 0) AS n FROM c LEFT JOIN g USING (user_id, y)")
def class_summary(spark, sf_dir):
    return rounded(U.class_summary(events_table(spark, sf_dir), USER, "event_type", ["click", "error", "none"], ["value"]), "value", digits=4)


@query("tertiles", "WITH c AS (SELECT p_type, quantile_cont(p_retailprice, 1/3) AS a, quantile_cont(p_retailprice, 2/3) AS b FROM part GROUP BY 1) SELECT p_partkey, 1 + (p_retailprice > a)::INT + CASE WHEN b > a THEN (p_retailprice > b)::INT ELSE 0 END AS bin FROM part JOIN c USING (p_type)")
def tertiles(spark, sf_dir):
    return U.quantile_bins(table(spark, sf_dir, "part"), ["p_type"], "p_retailprice").select("p_partkey", "bin")


@query("top_n_per_group", "SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5")
def top_n_per_group(spark, sf_dir):
    return U.top_n(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5).select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(spark, sf_dir):
    return U.top_n(table(spark, sf_dir, "orders"), [], [F.desc("o_totalprice"), F.col("o_orderkey")], 20).select("o_orderkey", "o_totalprice")


@query("argmax_row", "SELECT p_brand, p_partkey, p_name, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn = 1")
def argmax_row(spark, sf_dir):
    return U.arg_best(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", "p_partkey", ["p_name"])


@query("sample_per_group", f"WITH {E} SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('7:' || event_id)) AS rn FROM e) WHERE rn <= 3")
def sample_per_group(spark, sf_dir):
    return U.sample_n(events_table(spark, sf_dir), USER, F.col("event_id"), "7", 3).select("user_id", "event_id")


@query("robust_minmax", f"WITH {E}, q AS (SELECT event_type, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM e GROUP BY 1) SELECT event_id, round(greatest(least((value - a) / (b - a), 1.0), 0.0), 6) AS scaled FROM e JOIN q USING (event_type)")
def robust_minmax(spark, sf_dir):
    return rounded(U.robust_minmax(events_table(spark, sf_dir), ["event_type"], "value", "scaled").select("event_id", "scaled"), "scaled")


@query("rank_zscore", f"WITH {E} SELECT event_id, round((value - avg(value) OVER (PARTITION BY user_id)) / nullif(stddev_pop(value) OVER (PARTITION BY user_id), 0), 6) AS z FROM e")
def rank_zscore(spark, sf_dir):
    from beatlake.operators.beats import zscore

    return rounded(zscore(events_table(spark, sf_dir), USER, "value", "z").select("event_id", "z"), "z")


CLASSED = "x AS (SELECT CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'N' THEN 2 ELSE 3 END AS y, CASE WHEN l_quantity >= 34 THEN 1 WHEN l_quantity >= 17 THEN 2 ELSE 3 END AS p, l_quantity AS q FROM lineitem)"


def classed(spark, sf_dir):
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(F.when(flag == "A", 1).when(flag == "N", 2).otherwise(3).alias("y"), C.three_bins(F.col("l_quantity"), 34, 17).alias("p"), F.col("l_quantity").alias("q"))


@query("confusion_matrix", f'WITH {CLASSED} SELECT y, count(*) FILTER (WHERE p = 1) AS "1", count(*) FILTER (WHERE p = 2) AS "2", count(*) FILTER (WHERE p = 3) AS "3" FROM x GROUP BY 1')
def confusion_matrix(spark, sf_dir):
    return U.confusion(classed(spark, sf_dir), "y", "p", [1, 2, 3])


@query("class_scores", f"WITH {CLASSED}, c AS (SELECT k AS class, count(*) FILTER (WHERE y = k AND p = k) AS tp, count(*) FILTER (WHERE p = k AND y <> k) AS fp, count(*) FILTER (WHERE y = k AND p <> k) AS fn FROM x, (VALUES (1), (2), (3)) v(k) GROUP BY 1) SELECT class, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def class_scores(spark, sf_dir):
    return rounded(U.class_scores(classed(spark, sf_dir), "y", "p", [1, 2, 3]), "precision", "recall", "f1")


@query("fit_two_cuts", f"""WITH {CLASSED}, g AS (SELECT row_number() OVER (ORDER BY a.c, b.c) AS r, a.c AS t1, b.c AS t2 FROM (VALUES (10.0), (20.0), (30.0), (40.0)) a(c), (VALUES (10.0), (20.0), (30.0), (40.0)) b(c) WHERE a.c > b.c), z AS (SELECT r, t1, t2, y, CASE WHEN q >= t1 THEN 1 WHEN q >= t2 THEN 2 ELSE 3 END AS p FROM x, g),
f AS (SELECT r, t1, t2, k, 2 * count(*) FILTER (WHERE y = k AND p = k) / greatest(count(*) FILTER (WHERE y = k) + count(*) FILTER (WHERE p = k), 1) AS f FROM z, (VALUES (1), (2), (3)) v(k) GROUP BY ALL), m AS (SELECT r, t1, t2, sum(f) / 3 AS m FROM f GROUP BY ALL) SELECT t1::DOUBLE AS t1, t2::DOUBLE AS t2, round(m, 6) AS macro_f1 FROM m ORDER BY round(m, 9) DESC, r LIMIT 1""")
def fit_two_cuts(spark, sf_dir):
    return rounded(U.fit_two_cuts(classed(spark, sf_dir), "q", "y", [10.0, 20.0, 30.0, 40.0]), "macro_f1")


SPLIT = "h AS (SELECT y, q, ('0x' || substr(md5('split:' || k), 1, 12))::UBIGINT::DOUBLE AS h FROM (SELECT CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS y, l_quantity AS q, l_orderkey || '-' || l_linenumber AS k FROM lineitem)), c AS (SELECT y, quantile_cont(h, 0.8) AS cut FROM h GROUP BY 1), s AS (SELECT h.y, q, h <= cut AS train FROM h JOIN c USING (y))"


@query("cuts_on_held_out", f"""WITH {SPLIT}, v(c) AS (VALUES (5.0), (10.0), (15.0), (20.0), (25.0), (30.0), (35.0), (40.0), (45.0)), g AS (SELECT row_number() OVER (ORDER BY a.c, b.c) AS r, a.c::DOUBLE AS t1, b.c::DOUBLE AS t2 FROM v a, v b WHERE a.c > b.c),
n AS (SELECT train, y, q, count(*) AS n FROM s GROUP BY ALL), z AS (SELECT r, t1, t2, train, y, CASE WHEN q >= t1 THEN 1 WHEN q >= t2 THEN 2 ELSE 3 END AS p, n FROM n, g),
f AS (SELECT r, t1, t2, train, k, 2 * coalesce(sum(n) FILTER (WHERE y = k AND p = k), 0) / greatest(coalesce(sum(n) FILTER (WHERE y = k), 0) + coalesce(sum(n) FILTER (WHERE p = k), 0), 1) AS f FROM z, (VALUES (1), (2), (3)) w(k) GROUP BY ALL), m AS (SELECT r, t1, t2, train, sum(f) / 3 AS m FROM f GROUP BY ALL), b AS (SELECT * FROM m WHERE train ORDER BY round(m, 9) DESC, r LIMIT 1)
SELECT b.t1, b.t2, round(b.m, 6) AS train_macro_f1, (SELECT count(*) FROM s WHERE NOT train) AS n_test, round(m.m, 6) AS test_macro_f1 FROM b JOIN m ON m.r = b.r AND NOT m.train""")
def cuts_on_held_out(spark, sf_dir):
    """Cut points of a quality score fitted on four fifths of the rows of each class and scored on the rest."""
    flag = F.col("l_returnflag")
    x = table(spark, sf_dir, "lineitem").select(F.when(flag == "A", 1).when(flag == "N", 2).otherwise(3).alias("y"), F.col("l_quantity").alias("q"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k"))
    return rounded(U.fit_and_test(x, "q", "y", F.col("k"), [5.0 * i for i in range(1, 10)], "split"), "train_macro_f1", "test_macro_f1")


@query("filename_parse", r"""WITH x AS (SELECT s_suppkey, 'dir/P' || lpad((s_suppkey % 43)::VARCHAR, 2, '0') || CASE s_suppkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'B' ELSE '' END || '_R' || lpad((s_suppkey % 7)::VARCHAR, 2, '0') || CASE WHEN s_suppkey % 11 = 0 THEN '_oops.csv' ELSE '_NeuroKit_rr_aligned.csv' END AS f FROM supplier)
SELECT s_suppkey, CASE WHEN s_suppkey % 11 <> 0 THEN s_suppkey % 43 END AS patient_id, CASE WHEN s_suppkey % 11 <> 0 THEN CASE s_suppkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END END AS enrollment_id, CASE WHEN s_suppkey % 11 <> 0 THEN s_suppkey % 7 END AS recording_id, CASE WHEN s_suppkey % 11 <> 0 THEN 'neurokit' END AS algo_id FROM x""")
def filename_parse(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("dir/P"), F.lpad((k % 43).cast("string"), 2, "0"), F.when(k % 3 == 0, "a").when(k % 3 == 1, "B").otherwise(""), F.lit("_R"), F.lpad((k % 7).cast("string"), 2, "0"), F.when(k % 11 == 0, "_oops.csv").otherwise("_NeuroKit_rr_aligned.csv"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", C.parse_rr_file(name).alias("p")).select("s_suppkey", "p.*")


@query("uid_format", "SELECT c_custkey, printf('P%02d%s_R%02d', c_custkey % 120, CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE '' END, c_nationkey) AS uid, printf('%02d:%02d:%02d', c_custkey * 37 // 3600, c_custkey * 37 // 60 % 60, c_custkey * 37 % 60) AS duration FROM customer")
def uid_format(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", C.recording_name(k % 120, F.when(k % 2 == 0, "a"), F.col("c_nationkey")).alias("uid"), C.duration_text(k * 37).alias("duration"))


@query("scalar_scores", f"WITH {E} SELECT event_id, round(least(greatest((value - 5) / 20, 0.0), 1.0), 6) AS score, round(1 - least(greatest((value - 5) / 20, 0.0), 1.0), 6) AS inverse, round(10 * log10(value / 3.0), 6) AS snr, round(60.0 / greatest(value, 1e-12), 6) AS hr, CASE WHEN value >= 20 THEN 1 WHEN value >= 10 THEN 2 ELSE 3 END AS bin FROM e")
def scalar_scores(spark, sf_dir):
    v = F.col("value")
    x = events_table(spark, sf_dir).select("event_id", C.unit_score(v, 5, 25).alias("score"), C.unit_score(v, 5, 25, inverse=True).alias("inverse"), C.snr_db(v, F.lit(3.0)).alias("snr"), C.heart_rate(v).alias("hr"), C.three_bins(v, 20, 10).alias("bin"))
    return rounded(x, "score", "inverse", "snr", "hr")


@query("timezone_epochs", "SELECT event_id, round(epoch_us((ts AT TIME ZONE 'Europe/Copenhagen')::TIMESTAMPTZ) / 1e6, 6) AS epoch FROM events")
def timezone_epochs(spark, sf_dir):
    return rounded(table(spark, sf_dir, "events").select("event_id", C.epoch_of_local(F.col("ts")).alias("epoch")), "epoch")


@query("date_time_parse", """WITH x AS (SELECT o_orderkey, o_orderdate AS d, o_orderkey * 7919 % 86400 AS s FROM orders) SELECT o_orderkey, d + to_seconds(s) AS stamp FROM x""")
def date_time_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    s = k * 7919 % 86400
    fmt = F.when(k % 3 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    clock = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    return table(spark, sf_dir, "orders").select("o_orderkey", C.date_and_time(C.parse_date(fmt), C.parse_time_seconds(clock)).alias("stamp"))

"""Quality windows: a recording is a supplier, its signal the extended prices in order of order key and line."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beatlake.operators import intervals as I
from beatlake.operators import quality as Q
from beatlake.operators.segments import absolute_times, align_day_shift, build_events, repaired_end, to_samples, trimmed
from beatlake.plans.q_events import HOUR, TRUTH, USER, truth
from beatlake.plans.registry import E, events_table, query, rounded, table

REC = ["rec"]
SIGNAL = "s AS (SELECT l_suppkey AS rec, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) - 1 AS i, l_extendedprice AS x FROM lineitem)"
STATS = f"""WITH {SIGNAL}, d AS (SELECT *, i // 10 AS window_idx, abs(x - lag(x) OVER (PARTITION BY rec, i // 10 ORDER BY i)) AS d FROM s), w AS (SELECT rec, window_idx, count(*) AS n, stddev_pop(x) AS std, min(x) AS mn, max(x) AS mx, max(x) - min(x) AS rg, median(d) AS dm FROM d GROUP BY 1, 2 HAVING count(*) = 10),
f AS (SELECT w.*, std < 20000 AS is_flatline, std > 1.2 * median(std) OVER (PARTITION BY rec) AS is_noiseburst, rg > 0.9 * (max(mx) OVER (PARTITION BY rec) - min(mn) OVER (PARTITION BY rec)) AS is_clipping FROM w)"""


def signal(spark, sf_dir):
    nth = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("rec"), (nth - 1).alias("i"), F.col("l_extendedprice").alias("x"))


def flagged(spark, sf_dir):
    return Q.quality_flags(Q.window_stats(signal(spark, sf_dir), REC, "i", "x", 10), REC, 20000.0, 1.2)


@query("quality_windows", f"{STATS} SELECT rec, window_idx, round(std, 4) AS std, round(rg, 4) AS range, round(dm, 4) AS diff_abs_med, is_flatline, is_noiseburst, is_clipping FROM f")
def quality_windows(spark, sf_dir):
    x = flagged(spark, sf_dir).select("rec", "window_idx", "std", "range", "diff_abs_med", "is_flatline", "is_noiseburst", "is_clipping")
    return rounded(x, "std", "range", "diff_abs_med", digits=4)


REC_Q = f"""{STATS}, r AS (SELECT rec, count(*) AS n_windows, median(std) AS m, quantile_cont(std, 0.01) AS p01, quantile_cont(std, 0.99) AS p99, median(rg) AS rm, avg(is_flatline::INT) AS ff, avg(is_noiseburst::INT) AS fn, avg(is_clipping::INT) AS fc FROM f GROUP BY 1)"""


@query("recording_quality", f"{REC_Q} SELECT rec, n_windows, round(m, 3) AS win_std_median, round(p01, 3) AS win_std_p01, round(p99, 3) AS win_std_p99, round(rm, 3) AS win_range_median, round(ff, 6) AS frac_flatline, round(fn, 6) AS frac_noiseburst, round(fc, 6) AS frac_clipping FROM r")
def recording_quality(spark, sf_dir):
    x = Q.recording_quality(flagged(spark, sf_dir), REC)
    x = x.select("rec", "n_windows", "win_std_median", "win_std_p01", "win_std_p99", "win_range_median", "frac_flatline", "frac_noiseburst", "frac_clipping")
    return rounded(rounded(x, "win_std_median", "win_std_p01", "win_std_p99", "win_range_median", digits=3), "frac_flatline", "frac_noiseburst", "frac_clipping")


@query("classify_recordings", f"""{REC_Q}, c AS (SELECT rec, concat_ws('; ', CASE WHEN ff > 0.1 THEN 'flatline share ' || printf('%.3f', ff) END, CASE WHEN fn > 0.3 THEN 'noise share ' || printf('%.3f', fn) END, CASE WHEN fc > 0.2 THEN 'clipping share ' || printf('%.3f', fc) END) AS bad,
concat_ws('; ', CASE WHEN ff > 0.05 THEN 'flatline share ' || printf('%.3f', ff) END, CASE WHEN fn > 0.05 THEN 'noise share ' || printf('%.3f', fn) END, CASE WHEN fc > 0.01 THEN 'clipping share ' || printf('%.3f', fc) END) AS warn, ff, fn, fc FROM r)
SELECT rec, CASE WHEN bad <> '' THEN 'bad' WHEN warn <> '' THEN 'borderline' ELSE 'good' END AS quality_label, CASE WHEN bad <> '' THEN bad ELSE warn END AS quality_reason, CASE WHEN ff > 0.5 THEN 'QL' WHEN greatest(ff, fn, fc) <= 0.01 THEN 'Q1' WHEN greatest(ff, fn, fc) <= 0.05 THEN 'Q2' ELSE 'Q3' END AS quality_class FROM c""")
def classify(spark, sf_dir):
    x = Q.classify_recordings(Q.recording_quality(flagged(spark, sf_dir), REC), flat=0.1, noise=0.3, clip=0.2)
    return x.select("rec", "quality_label", "quality_reason", Q.quality_class(F.col("frac_flatline"), F.col("frac_noiseburst"), F.col("frac_clipping")).alias("quality_class"))


@query("sqi_variants", f"""{STATS} SELECT count(*) AS n, count(*) FILTER (WHERE NOT (is_flatline OR is_noiseburst OR is_clipping)) AS n_acceptable, count(*) FILTER (WHERE NOT is_flatline AND std <= 30000) AS n_strict, count(*) FILTER (WHERE NOT is_noiseburst) AS n_noise, count(*) FILTER (WHERE std < 22000 AND rg < 70000) AS n_flat FROM f""")
def sqi_variants(spark, sf_dir):
    x = Q.add_variants(Q.acceptable(flagged(spark, sf_dir)), [Q.Variant("strict", ("is_flatline",), {"std": 30000.0}), Q.Variant("noise", ("is_noiseburst",))])
    n = lambda c: F.count(F.when(c, 1))
    return x.agg(F.count("*").alias("n"), n(F.col("is_acceptable")).alias("n_acceptable"), n(F.col("accept_strict")).alias("n_strict"), n(F.col("accept_noise")).alias("n_noise"), n((F.col("std") < 22000) & (F.col("range") < 70000)).alias("n_flat"))


@query("weighted_summary", """WITH m AS (SELECT l_returnflag, l_quantity AS w, unnest([struct_pack(metric := 'price', x := l_extendedprice), struct_pack(metric := 'discount', x := l_discount)]) AS s FROM lineitem)
SELECT l_returnflag, s.metric AS metric, count(*) AS n, round(avg(s.x), 4) AS mean, round(sum(s.x * w) / nullif(sum(w), 0), 4) AS weighted_mean, round(median(s.x), 4) AS median, round(quantile_cont(s.x, 0.1), 4) AS p10, round(quantile_cont(s.x, 0.9), 4) AS p90 FROM m GROUP BY 1, 2""")
def weighted_summary(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), "l_quantity")
    return rounded(Q.weighted_summary(x, ["l_returnflag"], ["price", "discount"], "l_quantity"), "mean", "weighted_mean", "median", "p10", "p90", digits=4)


#: Six-hour windows of a user's events with whether an annotated event overlaps, and their acceptance.
WIN = f"""{E}, {TRUTH}, w0 AS (SELECT user_id, floor(t / 21600)::BIGINT AS window_idx, max(value) AS mx, count(*) AS n FROM e GROUP BY 1, 2), w AS (SELECT *, window_idx * 21600.0::DOUBLE AS win_start_s, (window_idx + 1) * 21600.0::DOUBLE AS win_end_s, mx <= 25 AS ok,
EXISTS (SELECT 1 FROM truth s WHERE s.user_id = w0.user_id AND window_idx * 21600.0 < s.t1 AND (window_idx + 1) * 21600.0 > s.t0) AS ev FROM w0)"""


def six_hour_windows(spark, sf_dir):
    g = events_table(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / (6 * HOUR)).cast("bigint").alias("window_idx")).agg(F.max("value").alias("mx"), F.count("*").alias("n"))
    return g.withColumns({"win_start_s": F.col("window_idx") * 21600.0, "win_end_s": (F.col("window_idx") + 1) * 21600.0, "ok": F.col("mx") <= 25})


def six_hours(spark, sf_dir):
    """The windows with whether an annotated event overlaps them."""
    return I.overlap_flag(six_hour_windows(spark, sf_dir), truth(spark, sf_dir), USER, ["window_idx"], ("win_start_s", "win_end_s"), ("t0", "t1"), out="ev")


@query("retention_overall", f"""WITH {WIN} SELECT user_id, count(*) AS n_all, count(*) FILTER (WHERE ok) AS kept_all, count(*) FILTER (WHERE ev) AS n_event, count(*) FILTER (WHERE ev AND ok) AS kept_event, count(*) FILTER (WHERE NOT ev) AS n_baseline, count(*) FILTER (WHERE NOT ev AND ok) AS kept_baseline,
round(count(*) FILTER (WHERE ev AND ok) / nullif(count(*) FILTER (WHERE ev), 0), 6) AS share_event FROM w GROUP BY 1""")
def retention_overall(spark, sf_dir):
    x = Q.retention(six_hours(spark, sf_dir), USER, F.col("win_end_s") - F.col("win_start_s"), "ok", "ev")
    return rounded(x.select("user_id", "n_all", "kept_all", "n_event", "kept_event", "n_baseline", "kept_baseline", "share_event"), "share_event")


@query("retention_by_event", f"WITH {WIN} SELECT user_id, seizure_id, count(*) AS n_windows, count(*) FILTER (WHERE ok) AS n_kept, round(avg(ok::INT), 6) AS share_kept FROM w JOIN truth USING (user_id) WHERE win_start_s < t1 AND win_end_s > t0 GROUP BY 1, 2")
def retention_by_event(spark, sf_dir):
    p = I.overlap_pairs(six_hours(spark, sf_dir), truth(spark, sf_dir), USER, ("win_start_s", "win_end_s"), ("t0", "t1"))
    return rounded(Q.retention_by_event(p, USER, ["window_idx"], ["seizure_id"], "ok"), "share_kept")


@query("flag_table", f"WITH {WIN}, g AS (SELECT 'all' AS \"group\", * FROM w UNION ALL SELECT 'event', * FROM w WHERE ev UNION ALL SELECT 'baseline', * FROM w WHERE NOT ev) SELECT \"group\", count(*) AS n_windows, round(avg(ok::INT), 6) AS frac_ok FROM g GROUP BY 1")
def flag_table(spark, sf_dir):
    return rounded(Q.flag_table(six_hours(spark, sf_dir), ["ok"], "ev"), "frac_ok")


def bad_points(spark, sf_dir):
    e = events_table(spark, sf_dir).where("event_type = 'purchase'")
    return I.asof_window(e, six_hours(spark, sf_dir), USER, "t", "win_start_s", "win_end_s", ["ok"], ["event_id"])


@query("error_enrichment", f"""WITH {WIN}, x AS (SELECT ok, sum(win_end_s - win_start_s) / 60 AS minutes FROM w GROUP BY 1), p AS (SELECT ok, count(*) AS n_errors FROM e JOIN w ON w.user_id = e.user_id AND e.t >= win_start_s AND e.t < win_end_s WHERE event_type = 'purchase' GROUP BY 1)
SELECT ok, round(minutes, 4) AS minutes, coalesce(n_errors, 0) AS n_errors, round(coalesce(n_errors, 0) / nullif(minutes, 0), 8) AS errors_per_min FROM x LEFT JOIN p USING (ok)""")
def error_enrichment(spark, sf_dir):
    x = Q.error_enrichment(bad_points(spark, sf_dir), six_hours(spark, sf_dir), USER, "ok", F.col("win_end_s") - F.col("win_start_s"))
    return rounded(rounded(x, "minutes", digits=4), "errors_per_min", digits=8)


@query("error_enrichment_timebounded", f"""WITH {WIN}, b AS (SELECT user_id, min(t) AS t_min, max(t) AS t_max FROM e WHERE event_type = 'purchase' GROUP BY 1), x AS (SELECT ok, sum(least(win_end_s, t_max) - greatest(win_start_s, t_min)) / 60 AS minutes FROM w JOIN b USING (user_id) WHERE win_end_s > t_min AND win_start_s < t_max GROUP BY 1),
p AS (SELECT ok, count(*) AS n_errors FROM e JOIN w ON w.user_id = e.user_id AND e.t >= win_start_s AND e.t < win_end_s WHERE event_type = 'purchase' GROUP BY 1) SELECT ok, round(minutes, 4) AS minutes, coalesce(n_errors, 0) AS n_errors FROM x LEFT JOIN p USING (ok)""")
def error_enrichment_timebounded(spark, sf_dir):
    b = events_table(spark, sf_dir).where("event_type = 'purchase'").groupBy("user_id").agg(F.min("t").alias("t_min"), F.max("t").alias("t_max"))
    x = Q.error_enrichment(bad_points(spark, sf_dir), six_hours(spark, sf_dir), USER, "ok", F.lit(0.0), b)
    return rounded(x.select("ok", "minutes", "n_errors"), "minutes", digits=4)


@query("rejection_around_onset", f"""WITH {WIN}, r AS (SELECT user_id, seizure_id, floor((win_start_s - t) / 21600) * 21600 AS bin_s, avg((NOT ok)::INT) AS r FROM w JOIN truth USING (user_id) WHERE win_start_s - t BETWEEN -86400 AND 86400 GROUP BY 1, 2, 3) SELECT bin_s, round(avg(r), 6) AS rejection_rate, count(*) AS n_events FROM r GROUP BY 1""")
def rejection_around_onset(spark, sf_dir):
    x = Q.rejection_around_onset(six_hours(spark, sf_dir), truth(spark, sf_dir), USER, "win_start_s", "t", "ok", ["seizure_id"], 86400.0, 86400.0, 21600.0)
    return rounded(x, "rejection_rate")


@query("rejection_by_overlap", f"WITH {WIN} SELECT ev, count(*) AS n, round(avg((NOT ok)::INT), 6) AS rejected FROM w GROUP BY 1")
def rejection_by_overlap(spark, sf_dir):
    return rounded(six_hours(spark, sf_dir).groupBy("ev").agg(F.count("*").alias("n"), F.avg((~F.col("ok")).cast("int")).alias("rejected")), "rejected")


CODE = "CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END"


@query("majority_label", f"WITH {E}, c AS (SELECT user_id, floor(t / 86400)::BIGINT AS window_idx, {CODE} AS y, count(*) AS n FROM e WHERE {CODE} > 0 GROUP BY ALL) SELECT user_id, window_idx, y AS label FROM (SELECT *, row_number() OVER (PARTITION BY user_id, window_idx ORDER BY n DESC, y) AS rn FROM c) WHERE rn = 1")
def majority_label(spark, sf_dir):
    e = events_table(spark, sf_dir)
    y = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "purchase", 3).otherwise(0)
    return Q.window_label(e.select("user_id", F.floor(F.col("t") / 86400).cast("bigint").alias("window_idx"), y.alias("label")), USER, "window_idx", "label")


@query("population_thresholds", f"{STATS} SELECT round(quantile_cont(std, 0.99), 3) AS std_max, round(quantile_cont(rg, 0.05), 3) AS range_min FROM f")
def population_thresholds(spark, sf_dir):
    return rounded(Q.population_thresholds(flagged(spark, sf_dir), {"std": 0.99}, {"range": 0.05}), "std_max", "range_min", digits=3)


@query("classify_segments", f"{STATS} SELECT rec, window_idx, round(1 - ((std > 32000)::INT + (dm > 60000)::INT + (rg < 60000)::INT) / 3.0, 6) AS score, NOT (std > 32000 OR dm > 60000 OR rg < 60000) AS is_good FROM f")
def classify_segments(spark, sf_dir):
    x = Q.classify_segments(flagged(spark, sf_dir), {"std": 32000.0, "diff_abs_med": 60000.0}, {"range": 60000.0})
    return rounded(x.select("rec", "window_idx", "score", "is_good"), "score")


@query("noisy_ratio", f"{STATS} SELECT rec, round(avg((std > 28000)::INT), 6) AS noisy_ratio FROM f GROUP BY 1")
def noisy_ratio(spark, sf_dir):
    return rounded(Q.noisy_share(flagged(spark, sf_dir), REC, "std", 28000.0), "noisy_ratio")


@query("window_badness", f"{STATS} SELECT rec, window_idx, round(0.5 * is_noiseburst::INT + 0.3 * is_flatline::INT + 0.2 * is_clipping::INT, 6) AS badness, 0.5 * is_noiseburst::INT + 0.3 * is_flatline::INT + 0.2 * is_clipping::INT > 0.4 AS is_bad FROM f")
def window_badness(spark, sf_dir):
    score, bad = Q.window_badness(F.col("is_noiseburst"), F.col("is_flatline"), F.col("is_clipping"))
    return rounded(flagged(spark, sf_dir).select("rec", "window_idx", score.alias("badness"), bad.alias("is_bad")), "badness")


@query("seizure_builder", """WITH r AS (SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, o.o_orderdate AS rs, o.o_orderdate + INTERVAL 120 DAY AS re, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_shipdate END AS es, l_shipdate + INTERVAL 2 DAY AS ee, l_shipdate - INTERVAL 1 DAY AS cs, l_shipdate + INTERVAL 3 DAY AS ce FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
c AS (SELECT *, CASE WHEN es IS NOT NULL THEN 'eeg' ELSE 'clinical' END AS chosen, coalesce(es, cs) AS s, CASE WHEN es IS NOT NULL THEN ee ELSE ce END AS f FROM r) SELECT l_orderkey, l_linenumber, l_partkey, chosen, round((epoch_us(greatest(s, rs)) - epoch_us(rs)) / 1e6, 6) AS t0, round((epoch_us(least(f, re)) - epoch_us(rs)) / 1e6, 6) AS t1, greatest((epoch_us(least(f, re)) - epoch_us(rs)) / 1e6 - 86400, 0) > 0 AS in_trim FROM c WHERE s < re AND f > rs AND f >= s""")
def seizure_builder(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    day = lambda c, n: F.col(c) + F.make_dt_interval(F.lit(n))
    x = li.join(o, li.l_orderkey == o.o_orderkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("o_orderdate").alias("rs"), day("o_orderdate", 120).alias("re"), F.when(F.col("l_returnflag") != "R", F.col("l_shipdate")).alias("es"),
        day("l_shipdate", 2).alias("ee"), day("l_shipdate", -1).alias("cs"), day("l_shipdate", 3).alias("ce"), F.lit(86400.0).alias("trim"),
    )
    x = build_events(x, "rs", "re", ("es", "ee"), ("cs", "ce"), "trim")
    return rounded(x.select("l_orderkey", "l_linenumber", "l_partkey", "chosen", "t0", "t1", "in_trim"), "t0", "t1")


@query("sample_align", f"WITH {E}, {TRUTH} SELECT user_id, seizure_id, least(greatest(round_even(t0 * 0.5, 0)::BIGINT, 0), 999999) AS i0, greatest(least(round_even(t1 * 0.5, 0)::BIGINT, 1000000), least(greatest(round_even(t0 * 0.5, 0)::BIGINT, 0), 999999) + 1) AS i1, round(greatest(t0 - 3600, 0), 6) AS t0_trim FROM truth")
def sample_align(spark, sf_dir):
    x = to_samples(truth(spark, sf_dir), ("t0", "t1"), F.lit(0.5), F.lit(1_000_000).cast("bigint"))
    return rounded(x.select("user_id", "seizure_id", "i0", "i1", trimmed(F.col("t0"), F.lit(3600.0)).alias("t0_trim")), "t0_trim")


@query("window_absolute_times", f"WITH {WIN} SELECT user_id, window_idx, make_timestamp(1704067200000000 + (win_start_s * 1000000)::BIGINT) AS abs_start FROM w")
def window_absolute_times(spark, sf_dir):
    x = six_hours(spark, sf_dir).withColumn("rec_start", F.timestamp_micros(F.lit(1_704_067_200_000_000)).cast("timestamp_ntz"))
    return absolute_times(x, "rec_start", {"win_start_s": "abs_start"}).select("user_id", "window_idx", "abs_start")


@query("day_shift_repair", f"""WITH {E}, r AS (SELECT user_id, min(t) AS r0, max(t) - 864000 AS r1 FROM e GROUP BY 1), {TRUTH}, o AS (SELECT user_id, seizure_id, s.i, s.d, greatest(least(t1 + s.d * 86400, r1) - greatest(t0 + s.d * 86400, r0), 0) AS ov FROM truth JOIN r USING (user_id), (VALUES (0, 0), (1, -1), (2, 1), (3, -2), (4, 2)) s(i, d))
SELECT user_id, seizure_id, d AS day_shift, round(ov, 6) AS overlap_s FROM (SELECT *, row_number() OVER (PARTITION BY seizure_id ORDER BY ov DESC, i) AS rn FROM o) WHERE rn = 1""")
def day_shift_repair(spark, sf_dir):
    r = events_table(spark, sf_dir).groupBy("user_id").agg(F.min("t").alias("r0"), (F.max("t") - 864000).alias("r1"))
    x = align_day_shift(truth(spark, sf_dir).join(r, "user_id"), ("t0", "t1"), ("r0", "r1"))
    return rounded(x.select("user_id", "seizure_id", "day_shift", "overlap_s"), "overlap_s")


@query("end_time_repair", f"WITH {E}, x AS (SELECT event_id, t AS s, CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN t - 3600 WHEN event_type = 'error' THEN t + 200000 ELSE t + 60 END AS en, event_type = 'click' AS clock FROM e), y AS (SELECT *, CASE WHEN clock AND en < s THEN en + 86400 ELSE en END AS f FROM x) SELECT event_id, round(CASE WHEN f IS NULL OR f < s OR f - s > 172800 THEN s + 120 ELSE f END, 6) AS end_s FROM y")
def end_time_repair(spark, sf_dir):
    e = events_table(spark, sf_dir)
    t, kind = F.col("t"), F.col("event_type")
    end = F.when(kind == "view", F.lit(None).cast("double")).when(kind == "click", t - 3600).when(kind == "error", t + 200000).otherwise(t + 60)
    return e.select("event_id", F.round(repaired_end(t, end, kind == "click"), 6).alias("end_s"))

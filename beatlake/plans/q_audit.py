"""Audits and comparisons over events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatlake.operators import audit as A
from beatlake.operators import beats as B
from beatlake.operators import intervals as I
from beatlake.operators import matching as M
from beatlake.operators import signal as S
from beatlake.operators.segments import event_profile, sliding
from beatlake.plans.q_beats import ORDER, RR, intervals
from beatlake.plans.q_events import HOUR, PAIR, TRUTH, USER, rates_sql, trains, truth, walk_sql
from beatlake.plans.q_quality import WIN, six_hours
from beatlake.plans.q_signal import FS, PSD, X, band_sql, segments
from beatlake.plans.registry import E, events_table, query, rounded, table


@query("short_annotations", f"WITH {E}, x AS (SELECT event_id, t, t + value - 5 AS f FROM e WHERE event_type = 'error') SELECT event_id, round(f - t, 4) AS duration_s FROM x WHERE f - t < 10")
def short_annotations(spark, sf_dir):
    e = events_table(spark, sf_dir).where("event_type = 'error'").withColumn("f", F.col("t") + F.col("value") - 5)
    return rounded(A.short_annotations(e, "t", "f").select("event_id", "duration_s"), "duration_s", digits=4)


@query("audit_candidates", f"{PAIR}, {walk_sql('21600.0')}, {rates_sql('user_id')} SELECT user_id, round(f1, 6) AS f1, fn + fp AS mismatches FROM g WHERE coalesce(f1 < 0.2 OR fn + fp > 15 OR p95 > 2e7, TRUE)")
def audit_candidates(spark, sf_dir):
    a, b = trains(spark, sf_dir)
    x = M.metrics(M.greedy_match(a, b, USER, "t", 6 * HOUR), USER)
    return rounded(A.audit_candidates(x, 0.2, 15, 2e7).select("user_id", "f1", "mismatches"), "f1")


@query("best_start", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 1 DAY END) AS start FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")
def best_start(spark, sf_dir):
    k = F.col("o_orderkey")
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 == 0, F.col("o_orderdate")).alias("a"), F.when(k % 5 == 0, F.col("o_orderdate") + F.make_dt_interval(F.lit(1))).alias("b"))
    return A.with_any_value(x, ["a", "b"]).select("o_orderkey", F.coalesce("a", "b").alias("start"))


@query("time_windows", f"""WITH {E}, x AS (SELECT user_id, t - min(t) OVER (PARTITION BY user_id) AS t, value FROM e), w AS (SELECT user_id, value, unnest(range(greatest(floor((t - 172800) / 86400) + 1, 0)::BIGINT, floor(t / 86400)::BIGINT + 1)) AS window_idx FROM x)
SELECT user_id, window_idx, count(*) AS n, round(avg(value), 8) AS mean, round(stddev_samp(value) / nullif(avg(value), 0), 8) AS cv FROM w GROUP BY 1, 2""")
def time_windows(spark, sf_dir):
    return rounded(A.time_windows(events_table(spark, sf_dir), USER, "t", "value", 48 * HOUR, 24 * HOUR), "mean", "cv", digits=8)


@query("values_by_segment", f"""WITH {WIN}, g AS (SELECT w.user_id, w.window_idx, count(*) AS n, median(value) AS m, avg(value) AS a FROM w JOIN e ON e.user_id = w.user_id AND e.t >= win_start_s AND e.t < win_end_s GROUP BY 1, 2)
SELECT user_id, window_idx, g.n AS n, round(CASE WHEN g.n >= 3 THEN m END, 6) AS median, round(CASE WHEN g.n >= 3 THEN a END, 8) AS mean FROM w JOIN g USING (user_id, window_idx)""")
def values_by_segment(spark, sf_dir):
    w = six_hours(spark, sf_dir).select("user_id", "window_idx", "win_start_s", "win_end_s")
    x = A.by_segment(events_table(spark, sf_dir), w, USER, ["window_idx"], "t", "value", ("win_start_s", "win_end_s"))
    return rounded(rounded(x, "median"), "mean", digits=8)


@query("painted_scores", f"WITH {WIN}, v AS (SELECT user_id, window_idx, win_start_s, win_end_s + 21600 AS win_end_s, mx FROM w) SELECT e.user_id, e.event_id, round(avg(v.mx), 8) AS mx FROM e LEFT JOIN v ON v.user_id = e.user_id AND e.t >= v.win_start_s AND e.t < v.win_end_s GROUP BY 1, 2")
def painted_scores(spark, sf_dir):
    w = six_hours(spark, sf_dir).withColumn("win_end_s", F.col("win_end_s") + 6 * HOUR)
    x = A.painted(events_table(spark, sf_dir), w, USER, "t", ("win_start_s", "win_end_s"), "mx")
    return rounded(x.select("user_id", "event_id", "mx"), "mx", digits=8)


@query("compare_definitions", f"""WITH {RR}, x AS (SELECT user_id, rr, quantile_cont(rr, 0.5) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM rr)
SELECT user_id, count(*) AS n, round(corr(rr, m), 6) AS corr, round(median(abs(rr - m)), 3) AS median_abs_diff, round(quantile_cont(abs(rr - m), 0.99), 3) AS p99_abs_diff FROM x GROUP BY 1""")
def compare_definitions(spark, sf_dir):
    x = B.median_beats(intervals(spark, sf_dir), USER, ORDER, mode="shrink", out="m")
    x = A.compare_definitions(x, USER, "rr", "m").select("user_id", "n", "corr", "median_abs_diff", "p99_abs_diff")
    return rounded(rounded(x, "corr"), "median_abs_diff", "p99_abs_diff", digits=3)


@query("match_rate", f"WITH {E} SELECT a.user_id, round(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM e b WHERE b.user_id = a.user_id AND b.event_type = 'view' AND abs(b.t - a.t) <= 7200.000000001)) / count(*), 6) AS match_rate FROM e a WHERE event_type = 'click' GROUP BY 1")
def match_rate(spark, sf_dir):
    a, b = trains(spark, sf_dir)
    return rounded(A.match_rate(M.band_match(a, b, USER, "t", 2 * HOUR), a, USER), "match_rate")


@query("beat_correlation", """WITH s AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM embeddings, LATERAL (SELECT unnest(range(1, 65)) AS i)), m AS (SELECT label, i, avg(x) AS m FROM s GROUP BY 1, 2)
SELECT label, vec_id, round(corr(x, m), 6) AS template_corr FROM s JOIN m USING (label, i) GROUP BY 1, 2""")
def beat_correlation(spark, sf_dir):
    return rounded(A.beat_correlation(segments(spark, sf_dir), ["label"], "vec_id"), "template_corr")


@query("beat_sqi", """WITH s AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM embeddings, LATERAL (SELECT unnest(range(1, 65)) AS i)), m AS (SELECT label, i, avg(x) AS m FROM s GROUP BY 1, 2), c AS (SELECT label, vec_id, corr(x, m) AS c FROM s JOIN m USING (label, i) GROUP BY 1, 2)
SELECT label, round(avg(c), 6) AS mean_corr, round(avg((c >= 0.5)::INT), 6) AS share_good FROM c GROUP BY 1""")
def beat_sqi(spark, sf_dir):
    return rounded(A.beat_sqi(A.beat_correlation(segments(spark, sf_dir), ["label"], "vec_id"), ["label"]), "mean_corr", "share_good")


@query("rr_consistency", f"WITH {RR}, x AS (SELECT user_id, rr, lag(rr) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM rr) SELECT user_id, round(avg((abs(rr - p) <= 0.2 * p)::INT), 6) AS consistency FROM x WHERE p IS NOT NULL GROUP BY 1")
def rr_consistency(spark, sf_dir):
    return rounded(A.rr_consistency(intervals(spark, sf_dir), USER, ORDER), "consistency")


@query("mse_offset", """WITH s AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, LATERAL (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2), b AS (SELECT (label + 1) % 10 AS label, i, x FROM s), o AS (SELECT r AS rank, r - 5 AS off FROM range(11) t(r)),
g AS (SELECT a.label, rank, off, round(avg((a.x - b.x) ** 2), 9) AS mse FROM s a JOIN b ON a.label = b.label JOIN o ON a.i = b.i + off GROUP BY ALL) SELECT label, off AS "offset", round(mse, 6) AS mse FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY mse, rank) AS rn FROM g) WHERE rn = 1""")
def mse_offset(spark, sf_dir):
    s = segments(spark, sf_dir).select("label", F.posexplode("samples").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    b = s.withColumn("label", (F.col("label") + 1) % 10)
    return rounded(A.mse_offset(s, b, ["label"], "i", "x", list(range(-5, 6))), "mse")


@query("event_profile", f"WITH {E}, {TRUTH} SELECT floor(e.t - s.t)::BIGINT AS rel_s, round(avg(value), 8) AS mean_value, count(*) AS n FROM e JOIN truth s USING (user_id) WHERE floor(e.t - s.t) BETWEEN -3600 AND 3600 GROUP BY 1")
def profile(spark, sf_dir):
    return rounded(event_profile(events_table(spark, sf_dir), truth(spark, sf_dir).withColumnRenamed("t", "on"), USER, "t", "value", "on", 3600, 3600), "mean_value", digits=8)


@query("near_recording_span", f"WITH {E}, {TRUTH}, s AS (SELECT user_id, min(t) AS lo, max(t) AS hi FROM e WHERE event_type = 'view' GROUP BY 1) SELECT truth.user_id, seizure_id FROM truth JOIN s USING (user_id) WHERE t >= lo - 7200 AND t <= hi + 7200")
def near_recording_span(spark, sf_dir):
    s = events_table(spark, sf_dir).where("event_type = 'view'").groupBy("user_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return I.near_range(truth(spark, sf_dir), s, USER, "t", "lo", "hi", 2 * HOUR).select("user_id", "seizure_id")


@query("sliding_windows", f"WITH {E}, r AS (SELECT user_id, max(t) AS dur FROM e GROUP BY 1), w AS (SELECT user_id, unnest(range(greatest(floor((dur - 172800) / 86400) + 1, 1)::BIGINT)) AS window_idx FROM r) SELECT user_id, window_idx, window_idx * 86400.0::DOUBLE AS win_start_s, window_idx * 86400.0::DOUBLE + 172800 AS win_end_s FROM w")
def sliding_windows(spark, sf_dir):
    r = events_table(spark, sf_dir).groupBy("user_id").agg(F.max("t").alias("dur"))
    return sliding(r, "dur", 48 * HOUR, 24 * HOUR).select("user_id", "window_idx", "win_start_s", "win_end_s")


@query("noise_index", f"WITH {PSD}, {band_sql({'lf': (0, 4), 'hf': (56, 64)})} SELECT vec_id, round(least(1.0, 5 * max(share) FILTER (WHERE band = 'lf') + 20 * max(share) FILTER (WHERE band = 'hf')), 6) AS noise_index FROM sh GROUP BY 1")
def noise_index(spark, sf_dir):
    p = S.band_powers(S.psd(segments(spark, sf_dir), ["vec_id"], "samples", FS, 64), ["vec_id"], {"lf": (0.0, 4.0), "hf": (56.0, 64.0)})
    x = p.groupBy("vec_id").pivot("band", ["lf", "hf"]).agg(F.first("share"))
    return rounded(x.select("vec_id", A.noise_index(F.col("lf"), F.col("hf")).alias("noise_index")), "noise_index")


@query("noise_fingerprint", f"""WITH {PSD}, g AS (SELECT label, (f * 64 / {FS})::INT AS bin, avg(p) AS power FROM d JOIN embeddings USING (vec_id) GROUP BY 1, 2), t AS (SELECT *, power > coalesce(lag(power) OVER w, -1) AND power >= coalesce(lead(power) OVER w, -1) AS top FROM g WINDOW w AS (PARTITION BY label ORDER BY bin)),
r AS (SELECT label, bin, power, row_number() OVER (PARTITION BY label ORDER BY power DESC, bin) AS rank FROM t WHERE top) SELECT label, bin, round(power, 9) AS power, rank FROM r WHERE rank <= 3""")
def noise_fingerprint(spark, sf_dir):
    p = S.psd(segments(spark, sf_dir), ["vec_id", "label"], "samples", FS, 64).select("label", F.posexplode("p").alias("bin", "power")).groupBy("label", "bin").agg(F.avg("power").alias("power"))
    return rounded(A.spectral_peaks(p, ["label"], "bin", "power", 3), "power", digits=9)


@query("modulation_depth", f"""WITH {X}, y AS (SELECT vec_id, h, [x[h * 16 + n + 1] * (0.5 - 0.5 * cos(2 * pi() * n / 32)) FOR n IN range(32)] AS y FROM x, (SELECT unnest(range(3)) AS h)),
m AS (SELECT vec_id, k AS bin, sqrt(pow(list_sum([y[n + 1] * cos(2 * pi() * ((k * n) % 32) / 32) FOR n IN range(32)]), 2) + pow(list_sum([y[n + 1] * sin(2 * pi() * ((k * n) % 32) / 32) FOR n IN range(32)]), 2)) AS m FROM y, (SELECT unnest(range(17)) AS k))
SELECT vec_id, bin::INT AS bin, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std, round(stddev_pop(m) / nullif(avg(m), 0), 6) AS depth FROM m GROUP BY 1, 2""")
def modulation_depth(spark, sf_dir):
    f = S.spectrogram(segments(spark, sf_dir), ["vec_id"], "samples", FS, 0.25, 0.125)
    return rounded(A.modulation(f, ["vec_id"], "t_frame", "magnitude"), "mean", "std", "depth")

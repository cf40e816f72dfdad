"""Beat features over events: a recording is a user, a beat is an event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatlake.functions.scalars import heart_rate
from beatlake.operators import beats as B
from beatlake.operators import ranges as R
from beatlake.plans.registry import E, events_table, query, rounded

USER, ORDER = ["user_id"], ["t", "event_id"]
DAY = 86400.0
#: Beats of a window; users have 45 to 99.
N = 20
RR = f"""{E}, rr AS (SELECT * FROM (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS rr FROM e) WHERE rr IS NOT NULL)"""
FRAME = "OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN {} AND {})"
W = "(PARTITION BY user_id ORDER BY t, event_id)"


def intervals(spark, sf_dir) -> DataFrame:
    return B.rr_from_peaks(events_table(spark, sf_dir), USER, ORDER)


@query("rr_intervals", f"WITH {E} SELECT user_id, event_id, round(t, 6) AS t, round(rr, 6) AS rr, round(sum(rr) OVER (PARTITION BY user_id ORDER BY t, event_id), 6) AS t_beat FROM (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS rr FROM e) WHERE rr IS NOT NULL")
def rr_intervals(spark, sf_dir):
    x = B.time_from_rr(B.rr_from_peaks(events_table(spark, sf_dir), USER, ORDER), USER, ORDER)
    return rounded(x.select("user_id", "event_id", "t", "rr", "t_beat"), "t", "rr", "t_beat")


@query("rr_median7_centered", f"""WITH {RR}, x AS (SELECT *, list(rr) {FRAME.format('3 PRECEDING', '3 FOLLOWING')} AS near, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER {W} AS i,
first_value(rr) {FRAME.format('UNBOUNDED PRECEDING', 'UNBOUNDED FOLLOWING')} AS f, last_value(rr) {FRAME.format('UNBOUNDED PRECEDING', 'UNBOUNDED FOLLOWING')} AS l FROM rr)
SELECT user_id, event_id, round(CASE WHEN n < 7 THEN rr ELSE list_sort(list_concat(list_concat([f FOR _ IN range(greatest(4 - i, 0))], near), [l FOR _ IN range(greatest(3 - (n - i), 0))]))[4] END, 6) AS rr_med FROM x""")
def rr_median7_centered(spark, sf_dir):
    return rounded(B.median_beats(intervals(spark, sf_dir), USER, ORDER).select("user_id", "event_id", "rr_med"), "rr_med")


@query("rr_median7_trailing", f"WITH {RR} SELECT user_id, event_id, round(quantile_cont(rr, 0.5) {FRAME.format('6 PRECEDING', 'CURRENT ROW')}, 7) AS trailing, round(quantile_cont(rr, 0.5) {FRAME.format('3 PRECEDING', '3 FOLLOWING')}, 7) AS shrinking FROM rr")
def rr_median7_trailing(spark, sf_dir):
    x = B.median_beats(intervals(spark, sf_dir), USER, ORDER, mode="trailing", out="trailing")
    x = B.median_beats(x, USER, ORDER, mode="shrink", out="shrinking")
    return rounded(x.select("user_id", "event_id", "trailing", "shrinking"), "trailing", "shrinking", digits=7)


POINCARE = f"""WITH {RR}, d AS (SELECT *, rr * 1000.0 AS ms, rr * 1000.0 - lag(rr * 1000.0) OVER {W} AS d, rr * 1000.0 + lag(rr * 1000.0) OVER {W} AS s, row_number() OVER {W} AS i FROM rr),
p AS (SELECT *, stddev_samp(d) {FRAME.format('18 PRECEDING', 'CURRENT ROW')} / sqrt(2.0) AS sd1, stddev_samp(s) {FRAME.format('18 PRECEDING', 'CURRENT ROW')} / sqrt(2.0) AS sd2,
stddev_samp(ms) {FRAME.format('19 PRECEDING', 'CURRENT ROW')} AS nn FROM d)"""


@query("poincare_csi_modcsi", f"""{POINCARE} SELECT user_id, event_id, round(sd1, 3) AS sd1, round(sd2, 3) AS sd2, round(sd2 / greatest(sd1, 1e-12), 6) AS csi, round(4 * sd2 * sd2 / greatest(sd1, 1e-12), 2) AS mod_csi FROM p WHERE i >= 20""")
def poincare_csi_modcsi(spark, sf_dir):
    x = B.poincare(intervals(spark, sf_dir).withColumn("rr_ms", F.col("rr") * 1000.0), USER, ORDER, n=N).where("sd1 is not null")
    x = x.withColumns({"csi": B.csi(F.col("sd1"), F.col("sd2")), "mod_csi": B.mod_csi(F.col("sd1"), F.col("sd2"))})
    x = rounded(rounded(x, "sd1", "sd2", digits=3), "mod_csi", digits=2)
    return rounded(x, "csi").select("user_id", "event_id", "sd1", "sd2", "csi", "mod_csi")


@query("poincare_formulas", f"""{POINCARE}, q AS (SELECT *, stddev_pop(d) {FRAME.format('18 PRECEDING', 'CURRENT ROW')} / sqrt(2.0) AS r1, stddev_pop(s) {FRAME.format('18 PRECEDING', 'CURRENT ROW')} / sqrt(2.0) AS r2 FROM p)
SELECT user_id, event_id, round(sqrt(greatest(2 * nn * nn - sd1 * sd1, 0)), 3) AS sdnn_sd2, round(r1, 3) AS rolling_sd1, round(r2, 3) AS rolling_sd2 FROM q WHERE i >= 20""")
def poincare_formulas(spark, sf_dir):
    x = intervals(spark, sf_dir).withColumn("rr_ms", F.col("rr") * 1000.0)
    x = B.poincare(x, USER, ORDER, n=N, formula="sdnn", prefix="sdnn_")
    x = B.poincare(x, USER, ORDER, n=N, formula="rolling", prefix="rolling_").where("sdnn_sd1 is not null")
    return rounded(x.select("user_id", "event_id", "sdnn_sd2", "rolling_sd1", "rolling_sd2"), "sdnn_sd2", "rolling_sd1", "rolling_sd2", digits=3)


@query("hr_slope", f"""WITH {RR}, c AS (SELECT *, sum(rr) {FRAME.format('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS tc, 60.0 / greatest(rr, 1e-12) AS h, row_number() OVER {W} AS i FROM rr)
SELECT * FROM (SELECT user_id, event_id, CASE WHEN i >= 20 THEN round(coalesce(abs(regr_slope(h, tc) {FRAME.format('19 PRECEDING', 'CURRENT ROW')}), 0) * 1e6, 3) END AS slope_micro FROM c) WHERE slope_micro IS NOT NULL""")
def hr_slope(spark, sf_dir):
    x = B.hr_slope(intervals(spark, sf_dir), USER, ORDER, n=N).where("slope is not null")
    return x.select("user_id", "event_id", F.round(F.col("slope") * 1e6, 3).alias("slope_micro"))


FEATURES = f"""WITH {RR}, c AS (SELECT *, sum(rr) {FRAME.format('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS t_s, list(rr) {FRAME.format('3 PRECEDING', '3 FOLLOWING')} AS near, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER {W} AS i,
first_value(rr) {FRAME.format('UNBOUNDED PRECEDING', 'UNBOUNDED FOLLOWING')} AS f, last_value(rr) {FRAME.format('UNBOUNDED PRECEDING', 'UNBOUNDED FOLLOWING')} AS l FROM rr),
m AS (SELECT *, CASE WHEN n < 7 THEN rr ELSE list_sort(list_concat(list_concat([f FOR _ IN range(greatest(4 - i, 0))], near), [l FOR _ IN range(greatest(3 - (n - i), 0))]))[4] END AS fr FROM c),
d AS (SELECT *, rr * 1000.0 - lag(rr * 1000.0) OVER {W} AS d1, rr * 1000.0 + lag(rr * 1000.0) OVER {W} AS s1, fr * 1000.0 - lag(fr * 1000.0) OVER {W} AS d2, fr * 1000.0 + lag(fr * 1000.0) OVER {W} AS s2, sum(fr) {FRAME.format('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS tf, 60.0 / greatest(fr, 1e-12) AS h FROM m),
p AS (SELECT *, stddev_samp(d1) {FRAME.format('18 PRECEDING', 'CURRENT ROW')} / sqrt(2.0) AS a1, stddev_samp(s1) {FRAME.format('18 PRECEDING', 'CURRENT ROW')} / sqrt(2.0) AS a2, stddev_samp(d2) {FRAME.format('18 PRECEDING', 'CURRENT ROW')} / sqrt(2.0) AS b1,
stddev_samp(s2) {FRAME.format('18 PRECEDING', 'CURRENT ROW')} / sqrt(2.0) AS b2, coalesce(abs(regr_slope(h, tf) {FRAME.format('19 PRECEDING', 'CURRENT ROW')}), 0) AS slope FROM d),
feat AS (SELECT user_id, event_id, t, t_s, a2 / greatest(a1, 1e-12) AS csi, 4 * b2 * b2 / greatest(b1, 1e-12) AS modcsi, slope FROM p WHERE i >= 20)"""


@query("seizure_features", f"{FEATURES} SELECT user_id, event_id, round(t_s, 6) AS t_s, round(csi, 6) AS csi, round(modcsi, 2) AS mod_csi_filt, round(slope * 1e6, 3) AS slope_micro, round(csi * slope * 1e6, 2) AS csi_x_slope_micro FROM feat")
def seizure_features(spark, sf_dir):
    x = B.seizure_features(intervals(spark, sf_dir), USER, ORDER, n=N)
    return x.select("user_id", "event_id", F.round("t_s", 6).alias("t_s"), F.round("CSI", 6).alias("csi"), F.round("ModCSI_filt", 2).alias("mod_csi_filt"), F.round(F.col("SlopeHR_abs") * 1e6, 3).alias("slope_micro"), F.round(F.col("CSI_x_Slope") * 1e6, 2).alias("csi_x_slope_micro"))


@query("lorenz_features", f"""WITH {RR}, d AS (SELECT *, rr - lag(rr) OVER {W} AS d, rr + lag(rr) OVER {W} AS s, row_number() OVER {W} AS i FROM rr),
p AS (SELECT *, 4 * stddev_samp(d) {FRAME.format('18 PRECEDING', 'CURRENT ROW')} / sqrt(2.0) AS tt, 4 * stddev_samp(s) {FRAME.format('18 PRECEDING', 'CURRENT ROW')} / sqrt(2.0) AS ll, regr_slope(rr, t) {FRAME.format('19 PRECEDING', 'CURRENT ROW')} AS k FROM d)
SELECT user_id, event_id, round(tt, 3) AS width, round(ll, 3) AS length, round(ll / nullif(tt, 0), 6) AS csi, round(ll * ll / nullif(tt, 0), 3) AS mod_csi, round(k * 1e3, 5) AS tacho_slope_milli FROM p WHERE i >= 20""")
def lorenz_features(spark, sf_dir):
    x = B.lorenz_features(intervals(spark, sf_dir), USER, ORDER, n=N)
    return x.select("user_id", "event_id", F.round("T", 3).alias("width"), F.round("L", 3).alias("length"), F.round("CSI", 6).alias("csi"), F.round("ModCSI", 3).alias("mod_csi"), F.round(F.col("tacho_slope") * 1e3, 5).alias("tacho_slope_milli"))


@query("rolling_slope_stride", f"""WITH {E}, x AS (SELECT *, regr_slope(value, t) {FRAME.format('19 PRECEDING', 'CURRENT ROW')} AS k, avg(t) {FRAME.format('19 PRECEDING', 'CURRENT ROW')} AS c, row_number() OVER {W} AS i FROM e)
SELECT user_id, event_id, round(k * 1e3, 5) AS slope_milli, round(c, 4) AS centre FROM x WHERE i >= 20 AND (i - 20) % 5 = 0""")
def rolling_slope_stride(spark, sf_dir):
    x = B.rolling_slope(events_table(spark, sf_dir), USER, ORDER, "value", "t", 20, 5)
    return x.select("user_id", "event_id", F.round(F.col("slope") * 1e3, 5).alias("slope_milli"), F.round("centre", 4).alias("centre"))


@query("slope_inflated", f"""WITH {E}, x AS (SELECT *, row_number() OVER {W} AS i FROM e)
SELECT user_id, event_id, round(k, 6) AS slope FROM (SELECT *, abs(covar_samp(value, i::DOUBLE) {FRAME.format('19 PRECEDING', 'CURRENT ROW')} / var_pop(i::DOUBLE) {FRAME.format('19 PRECEDING', 'CURRENT ROW')}) AS k FROM x) WHERE i >= 20""")
def slope_inflated(spark, sf_dir):
    x = B.slope_inflated(events_table(spark, sf_dir), USER, ORDER, "value", 20).where("slope is not null")
    return rounded(x.select("user_id", "event_id", "slope"), "slope")


@query("rolling_rms_z", f"""WITH {E}, x AS (SELECT *, sqrt(sum(value * value) {FRAME.format('5 PRECEDING', '4 FOLLOWING')} / 10.0) AS r, sum(value) {FRAME.format('5 PRECEDING', '4 FOLLOWING')} / 10.0 AS m FROM e)
SELECT user_id, event_id, round(r, 6) AS rolling_rms, round(m, 4) AS rolling_mean, round((r - avg(r) OVER (PARTITION BY user_id)) / nullif(stddev_pop(r) OVER (PARTITION BY user_id), 0), 6) AS rms_z FROM x""")
def rolling_rms_z(spark, sf_dir):
    x = B.rolling_rms(events_table(spark, sf_dir), USER, ORDER, "value", 10)
    return rounded(rounded(x.select("user_id", "event_id", "rolling_rms", "rolling_mean", "rms_z"), "rolling_rms", "rms_z"), "rolling_mean", digits=4)


@query("window_mean_time", f"WITH {E} SELECT user_id, event_id, round(avg(t) {FRAME.format('9 PRECEDING', 'CURRENT ROW')}, 3) AS centre, round(sum(value) {FRAME.format('3 PRECEDING', '3 FOLLOWING')} / 7.0, 5) AS moving_mean FROM e")
def window_mean_time(spark, sf_dir):
    e = events_table(spark, sf_dir)
    x = B.moving_sum_mean(e, USER, ORDER, "value", 7, "moving_mean").withColumn("centre", F.avg("t").over(B.series(USER, ORDER).rowsBetween(-9, 0)))
    return x.select("user_id", "event_id", F.round("centre", 3).alias("centre"), F.round("moving_mean", 5).alias("moving_mean"))


@query("hrv_summary", f"""WITH {RR}, d AS (SELECT *, rr - lag(rr) OVER {W} AS d FROM rr), g AS (SELECT user_id, count(*) AS n_rr, avg(rr) AS m, stddev_samp(rr) AS nn, sqrt(avg(d * d)) AS rmssd, stddev_samp(d) AS sdsd, avg((abs(d) > 50)::INT) AS pnn50 FROM d GROUP BY 1)
SELECT user_id, n_rr, round(m, 6) AS mean_nn, round(nn, 6) AS sdnn, round(rmssd, 6) AS rmssd, round(sdsd, 6) AS sdsd, round(pnn50, 6) AS pnn50, round(sdsd / sqrt(2.0), 6) AS sd1, round(sqrt(greatest(2 * nn * nn - sdsd * sdsd / 2, 0)), 6) AS sd2 FROM g""")
def hrv_summary(spark, sf_dir):
    x = B.hrv_summary(intervals(spark, sf_dir), USER, ORDER, "rr")
    cols = ("mean_nn", "sdnn", "rmssd", "sdsd", "pnn50", "sd1", "sd2")
    return rounded(x.select("user_id", "n_rr", *cols), *cols)


@query("window_hrv", f"""WITH {RR}, w AS (SELECT *, floor(t / 864000)::BIGINT AS window_idx FROM rr), d AS (SELECT *, rr - lag(rr) OVER (PARTITION BY user_id, window_idx ORDER BY t, event_id) AS d FROM w), g AS (SELECT user_id, window_idx, count(*) AS n_rr, avg(rr) AS m, stddev_samp(rr) AS nn, sqrt(avg(d * d)) AS rmssd, stddev_samp(d) AS sdsd, avg((abs(d) > 50)::INT) AS pnn50 FROM d GROUP BY 1, 2 HAVING count(*) >= 20)
SELECT user_id, window_idx, n_rr, round(m, 4) AS mean_nn, round(nn, 4) AS sdnn, round(rmssd, 4) AS rmssd, round(sdsd, 4) AS sdsd, round(pnn50, 6) AS pnn50, round(sdsd / sqrt(2.0), 4) AS sd1, round(sqrt(greatest(2 * nn * nn - sdsd * sdsd / 2, 0)), 3) AS sd2 FROM g""")
def window_hrv(spark, sf_dir):
    """Variability in windows of ten days that hold 20 intervals or more, from prefix sums."""
    x = intervals(spark, sf_dir)
    w = x.select("user_id", F.floor(F.col("t") / (10 * DAY)).cast("bigint").alias("window_idx")).distinct()
    w = w.withColumns({"t0": F.col("window_idx") * 10 * DAY, "t1": (F.col("window_idx") + 1) * 10 * DAY})
    out = R.window_hrv(x, w, USER, ["window_idx"], ["event_id"], "t", "rr", ("t0", "t1"), N, 4 * DAY)
    cols = ("mean_nn", "sdnn", "rmssd", "sdsd", "sd1")
    return rounded(rounded(rounded(out.select("user_id", "window_idx", "n_rr", *cols, "pnn50", "sd2"), *cols, digits=4), "pnn50"), "sd2", digits=3)


@query("rr_irregularity", f"""WITH {RR}, x AS (SELECT user_id, rr - quantile_cont(rr, 0.5) {FRAME.format('5 PRECEDING', '5 FOLLOWING')} AS r FROM rr), m AS (SELECT user_id, median(r) AS m FROM x GROUP BY 1),
a AS (SELECT user_id, abs(r - m) AS a FROM x JOIN m USING (user_id)), s AS (SELECT user_id, 1.4826 * median(a) AS mad FROM a GROUP BY 1) SELECT user_id, round(avg((a / greatest(mad, 1e-12) > 2.5)::INT), 6) AS irregular FROM a JOIN s USING (user_id) GROUP BY 1""")
def rr_irregularity(spark, sf_dir):
    return rounded(B.rr_irregularity(intervals(spark, sf_dir), USER, ORDER), "irregular")


@query("rr_local_outliers", f"""WITH {RR}, x AS (SELECT *, quantile_cont(rr, 0.5) {FRAME.format('5 PRECEDING', '5 FOLLOWING')} AS m FROM rr) SELECT user_id, count(*) AS n, count(*) FILTER (WHERE abs(rr - m) <= 0.12 * m) AS n_ok FROM x GROUP BY 1""")
def rr_local_outliers(spark, sf_dir):
    x = B.local_rr_outlier(intervals(spark, sf_dir), USER, ORDER)
    return x.groupBy("user_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("rr_ok"), 1)).alias("n_ok"))


@query("rr_clean_and_unit", f"""WITH {RR}, m AS (SELECT user_id, median(rr) AS m FROM rr GROUP BY 1), u AS (SELECT user_id, rr * CASE WHEN m > 10000 THEN 1e-6 WHEN m > 5 THEN 1e-3 WHEN m < 0.02 THEN 1e3 ELSE 1.0 END AS rr FROM rr JOIN m USING (user_id))
SELECT user_id, count(*) AS n, round(sum(rr), 6) AS total, round(avg(60.0 / greatest(rr, 1e-12)), 4) AS mean_hr FROM u WHERE rr BETWEEN 0.25 AND 2.5 GROUP BY 1""")
def rr_clean_and_unit(spark, sf_dir):
    x = B.clean_rr(B.normalised_rr(intervals(spark, sf_dir), USER))
    return x.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("rr"), 6).alias("total"), F.round(F.avg(heart_rate(F.col("rr"))), 4).alias("mean_hr"))


@query("beat_window_stride", f"WITH {RR}, x AS (SELECT *, row_number() OVER {W} AS i FROM rr) SELECT user_id, event_id, i FROM x WHERE i >= 30 AND (i - 30) % 10 = 0")
def beat_window_stride(spark, sf_dir):
    x = intervals(spark, sf_dir).withColumn("i", F.row_number().over(B.series(USER, ORDER)))
    return B.stride(x, USER, ORDER, 30, 10).select("user_id", "event_id", "i")

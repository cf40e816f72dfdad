"""Thresholds, detection scores and the detection study."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatlake.operators import beats as B
from beatlake.operators import events as V
from beatlake.operators import scoring as S
from beatlake.operators import thresholds as T
from beatlake.plans import studies
from beatlake.plans.q_beats import FEATURES, ORDER, RR, N, intervals
from beatlake.plans.q_events import HOUR, TRUTH, USER, truth
from beatlake.plans.q_quality import WIN, six_hour_windows
from beatlake.plans.registry import E, events_table, query, rounded


@query("patient_quantile_threshold", f"WITH {E} SELECT user_id, round(quantile_cont(value, 0.95), 4) AS threshold FROM e GROUP BY 1")
def patient_quantile_threshold(spark, sf_dir):
    return rounded(T.quantile_threshold(events_table(spark, sf_dir), USER, "value", 0.95), "threshold", digits=4)


@query("baseline_first_threshold", f"WITH {E}, x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e) SELECT user_id, round(quantile_cont(value, 0.995), 5) AS threshold FROM x WHERE i <= 30 GROUP BY 1")
def baseline_first(spark, sf_dir):
    return rounded(T.baseline_first_threshold(events_table(spark, sf_dir), USER, ["t", "event_id"], "value", 0.995, 30, 20), "threshold", digits=5)


AUTO = f"""WITH {E}, {TRUTH}, x AS (SELECT user_id % 10 AS patient_id, user_id AS recording_uid, t, value FROM e), sp AS (SELECT patient_id, recording_uid, max(t) AS en FROM x GROUP BY 1, 2), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY recording_uid) AS rn FROM sp) WHERE {{}}),
g AS (SELECT patient_id, recording_uid, v.rank, v.mode, coalesce(v.s, en / 2) AS s1 FROM f, (VALUES (0, 'first_96h', 345600.0::DOUBLE), (1, 'first_48h', 172800.0), (2, 'first_half', NULL)) v(rank, mode, s)),
h AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM truth WHERE user_id = recording_uid AND t0 < s1 AND t1 > 0)), m AS (SELECT h.patient_id, h.recording_uid, rank, mode, max(value) AS m FROM h JOIN x ON x.recording_uid = h.recording_uid AND x.t >= 0 AND x.t < s1 GROUP BY ALL)"""


def study_tables(spark, sf_dir):
    x = events_table(spark, sf_dir).select((F.col("user_id") % 10).alias("patient_id"), F.col("user_id").alias("recording_uid"), "t", "value")
    e = truth(spark, sf_dir).select(F.col("user_id").alias("recording_uid"), "t0", "t1")
    return x, e


SEGMENTS = {"first_96h": 345600.0, "first_48h": 172800.0, "first_half": None}


@query("auto_threshold", f"""{AUTO.format('rn = 1')}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY rank) AS rn FROM m) WHERE rn = 1), w AS (SELECT patient_id, max(value) AS g FROM x GROUP BY 1)
SELECT w.patient_id, round(1.05 * coalesce(m, g), 6) AS threshold, coalesce(mode, 'global_max') AS mode, recording_uid AS thr_recording FROM w LEFT JOIN b USING (patient_id)""")
def auto_threshold(spark, sf_dir):
    x, e = study_tables(spark, sf_dir)
    return rounded(T.segment_thresholds(x, e, "patient_id", "recording_uid", "t", "value", ("t0", "t1"), SEGMENTS), "threshold")


@query("auto_threshold_all", f"""{AUTO.format('TRUE')}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY m DESC, rank, mode DESC, recording_uid DESC) AS rn FROM m) WHERE rn = 1), w AS (SELECT patient_id, max(value) AS g FROM x GROUP BY 1)
SELECT w.patient_id, round(1.05 * coalesce(m, g), 6) AS threshold, coalesce(mode, 'global_max') AS mode, recording_uid AS thr_recording FROM w LEFT JOIN b USING (patient_id)""")
def auto_threshold_all(spark, sf_dir):
    x, e = study_tables(spark, sf_dir)
    return rounded(T.segment_thresholds(x, e, "patient_id", "recording_uid", "t", "value", ("t0", "t1"), SEGMENTS, first=False), "threshold")


@query("early_baseline_threshold", f"WITH {E} SELECT user_id, d AS definition, round(1.05 * max(value), 6) AS threshold FROM e, (VALUES ('day1', 86400.0), ('week1', 604800.0)) v(d, s) WHERE t < s GROUP BY 1, 2")
def early_baseline(spark, sf_dir):
    return rounded(T.early_baseline(events_table(spark, sf_dir), USER, "t", "value", {"day1": 86400.0, "week1": 604800.0}), "threshold")


@query("over_threshold_points", f"WITH {E}, th AS (SELECT user_id, quantile_cont(value, 0.9) AS threshold FROM e GROUP BY 1) SELECT user_id, count(*) AS n, round(avg((value > threshold)::INT), 6) AS share_over, sum((value > threshold)::INT) AS n_over FROM e JOIN th USING (user_id) GROUP BY 1")
def over_threshold_points(spark, sf_dir):
    e = events_table(spark, sf_dir)
    x = T.attach(e, T.quantile_threshold(e, USER, "value", 0.9), "user_id")
    return rounded(S.over_threshold(x, USER, "value", "threshold"), "share_over")


@query("analyzable_hours", f"WITH {WIN} SELECT user_id, round(sum(win_end_s - win_start_s) / 3600, 4) AS hours FROM w WHERE ok GROUP BY 1")
def analyzable_hours(spark, sf_dir):
    return rounded(S.analyzable_hours(six_hour_windows(spark, sf_dir), USER, ("win_start_s", "win_end_s"), F.col("ok"), USER), "hours", digits=4)


#: Points with their window's verdict, islands by SQI mode, and the scores of each mode and responder group.
SCORES = f"""WITH {WIN}, p AS (SELECT e.*, coalesce(w.ok, TRUE) AS ok FROM e LEFT JOIN w ON w.user_id = e.user_id AND w.window_idx = floor(e.t / 21600)::BIGINT), q AS (SELECT 'off' AS sqi, * FROM p UNION ALL SELECT 'on', * FROM p WHERE ok),
o AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY sqi, user_id ORDER BY t, event_id) > 43200 THEN 1 ELSE 0 END AS b FROM q WHERE value > 15), i AS (SELECT *, sum(b) OVER (PARTITION BY sqi, user_id ORDER BY t, event_id) AS isl FROM o),
f0 AS (SELECT sqi, user_id, min(t) AS f0, max(t) AS f1 FROM i GROUP BY sqi, user_id, isl), s0 AS (SELECT DISTINCT q.sqi, s.user_id, s.t0, s.t1 FROM truth s JOIN q USING (user_id)), h AS (SELECT sum(win_end_s - win_start_s) / 3600 AS hours FROM w)"""
GROUPS = "(VALUES ('all'), ('yes'), ('no')) g(responder)"
IN_GROUP = "(g.responder = 'all' OR (g.responder = 'yes') = (user_id % 3 = 0))"


def study(spark, sf_dir):
    """Points with acceptance, by SQI mode; detected events; annotated events of recordings that have points."""
    e, w = events_table(spark, sf_dir), six_hour_windows(spark, sf_dir)
    x = e.withColumn("window_idx", F.floor(F.col("t") / (6 * HOUR)).cast("bigint")).join(w.select("user_id", "window_idx", "ok"), ["user_id", "window_idx"], "left")
    q = S.with_sqi_modes(x, "ok", {"off": None, "on": "ok"})
    found = V.event_list(q, ["sqi", "user_id"], ["event_id"], "t", "value", 15.0, 12 * HOUR)
    true = truth(spark, sf_dir).select("user_id", "t0", "t1").join(q.select("sqi", "user_id").distinct(), "user_id")
    return found, true, S.analyzable_hours(w, USER, ("win_start_s", "win_end_s"))


@query("scoring_table", f"""{SCORES}, d AS (SELECT sqi, count(*) AS n_true, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM f0 WHERE f0.sqi = s0.sqi AND f0.user_id = s0.user_id AND f0 <= t1 + 21600 AND f1 >= t0 - 21600)) AS n_detected FROM s0 GROUP BY 1),
n AS (SELECT sqi, count(*) AS n_events, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM s0 WHERE s0.sqi = f0.sqi AND s0.user_id = f0.user_id AND f0 <= t1 + 21600 AND f1 >= t0 - 21600)) AS n_false FROM f0 GROUP BY 1)
SELECT sqi, n_events, n_true, n_detected, n_false, round(n_detected / n_true, 6) AS recall, round(n_false / hours, 6) AS far_per_h FROM d JOIN n USING (sqi), h""")
def scoring_table(spark, sf_dir):
    found, true, hours = study(spark, sf_dir)
    x = S.score(found, true, "user_id", ("t_start", "t_end"), ("t0", "t1"), 6 * HOUR, hours, ["sqi"])
    return rounded(x.select("sqi", "n_events", "n_true", "n_detected", "n_false", "recall", "far_per_h"), "recall", "far_per_h")


@query("responder_split", f"""{SCORES}, f2 AS (SELECT responder, f0.* FROM f0, {GROUPS} WHERE {IN_GROUP}), s2 AS (SELECT responder, s0.* FROM s0, {GROUPS} WHERE {IN_GROUP}),
d AS (SELECT sqi, responder, count(*) AS n_true, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM f0 WHERE f0.sqi = s2.sqi AND f0.user_id = s2.user_id AND f0 <= t1 + 21600 AND f1 >= t0 - 21600)) AS n_detected FROM s2 GROUP BY 1, 2),
n AS (SELECT sqi, responder, count(*) AS n_events, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM s0 WHERE s0.sqi = f2.sqi AND s0.user_id = f2.user_id AND f0 <= t1 + 21600 AND f1 >= t0 - 21600)) AS n_false FROM f2 GROUP BY 1, 2)
SELECT sqi, responder, n_events, n_true, n_detected, n_false, round(n_detected / n_true, 6) AS recall, round(n_false / hours, 6) AS far_per_h FROM d JOIN n USING (sqi, responder), h""")
def responder_split(spark, sf_dir):
    found, true, hours = study(spark, sf_dir)
    group = lambda df: df.withColumn("responder", F.when(F.col("user_id") % 3 == 0, "yes").otherwise("no"))
    x = S.score(group(found), group(true), "user_id", ("t_start", "t_end"), ("t0", "t1"), 6 * HOUR, hours, ["sqi", "responder"], "responder")
    return rounded(x.select("sqi", "responder", "n_events", "n_true", "n_detected", "n_false", "recall", "far_per_h"), "recall", "far_per_h")


@query("sqi_sweep", f"""WITH {WIN}, p AS (SELECT e.*, w.mx FROM e LEFT JOIN w ON w.user_id = e.user_id AND w.window_idx = floor(e.t / 21600)::BIGINT), q AS (SELECT v.m AS variant, p.* FROM p, (VALUES ('none', 1e9::DOUBLE), ('loose', 40), ('strict', 20)) v(m, lim) WHERE coalesce(mx <= lim, TRUE))
SELECT variant, count(*) AS n_points, count(DISTINCT user_id) AS n_recordings, round(avg((value > 15)::INT), 6) AS share_over FROM q GROUP BY 1""")
def sqi_sweep(spark, sf_dir):
    e, w = events_table(spark, sf_dir), six_hour_windows(spark, sf_dir)
    x = e.withColumn("window_idx", F.floor(F.col("t") / (6 * HOUR)).cast("bigint")).join(w.select("user_id", "window_idx", "mx"), ["user_id", "window_idx"], "left")
    x = x.withColumns({"loose": F.col("mx") <= 40, "strict": F.col("mx") <= 20})
    q = S.with_sqi_modes(x, "loose", {"none": None, "loose": "loose", "strict": "strict"}, "variant")
    return rounded(q.groupBy("variant").agg(F.count("*").alias("n_points"), F.countDistinct("user_id").alias("n_recordings"), F.avg((F.col("value") > 15).cast("int")).alias("share_over")), "share_over")


@query("peak_scores", f"""WITH {E}, {TRUTH}, o AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 43200 THEN 1 ELSE 0 END AS b FROM e WHERE value > 20), i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t, event_id) AS isl FROM o),
ev AS (SELECT user_id, min_by(t, (-value, t)) AS pk FROM i GROUP BY user_id, isl), z AS (SELECT user_id, EXISTS (SELECT 1 FROM truth s WHERE s.user_id = ev.user_id AND pk BETWEEN t0 - 7200 AND t1 + 7200) AS hit FROM ev) SELECT user_id, count(*) FILTER (WHERE hit) AS n_true, count(*) FILTER (WHERE NOT hit) AS n_false FROM z GROUP BY 1""")
def peak_scores(spark, sf_dir):
    found = V.event_list(events_table(spark, sf_dir), USER, ["event_id"], "t", "value", 20.0, 12 * HOUR)
    return S.peak_scores(found, truth(spark, sf_dir), USER, "t_peak", ("t0", "t1"), 2 * HOUR)


#: Beats of two sources for each recording, windows and annotated events on the axis from its first beat, features, thresholds of patients, events by mode.
STUDY = f"""WITH {RR}, fst AS (SELECT user_id, min(t) AS tf FROM e GROUP BY 1), truth AS (SELECT user_id, t - tf - 300 AS t0, t - tf + 300 AS t1 FROM e JOIN fst USING (user_id) WHERE event_type = 'error' AND value > 150),
win AS (SELECT user_id, floor((t - tf) / 21600)::BIGINT AS window_idx, max(value) <= 150 AS ok FROM e JOIN fst USING (user_id) GROUP BY 1, 2), s AS (SELECT user_id, v.rr_source, event_id, t, CASE WHEN v.rr_source = 'labview' THEN rr ELSE rr + event_id % 7 END AS rr FROM rr, (VALUES ('labview'), ('python')) v(rr_source)), c AS"""
STUDY += FEATURES.split(", c AS", 1)[1].replace("FROM rr),", "FROM s),").replace("PARTITION BY user_id", "PARTITION BY rr_source, user_id").replace("feat AS (SELECT user_id,", "feat AS (SELECT rr_source, user_id,")
STUDY += f""", x AS (SELECT user_id % 10 AS patient_id, user_id AS recording_uid, t_s AS t, modcsi * slope AS value FROM feat WHERE rr_source = 'labview'), {AUTO.format('rn = 1').split("FROM e), ", 1)[1].replace("m AS (SELECT h.", "free AS (SELECT h.").replace("first_96h', 345600.0", "first_20d', 1728000.0").replace("first_48h', 172800.0", "first_14d', 1209600.0")},
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY rank) AS rn FROM free) WHERE rn = 1), wm AS (SELECT patient_id, max(value) AS g FROM x GROUP BY 1), th AS (SELECT wm.patient_id, 1.05 * coalesce(m, g) AS thr FROM wm LEFT JOIN b USING (patient_id)),
pt AS (SELECT f.rr_source, f.user_id, f.event_id, f.t_s, f.modcsi * f.slope AS v, coalesce(w.ok, TRUE) AS ok FROM feat f LEFT JOIN win w ON w.user_id = f.user_id AND w.window_idx = floor(f.t_s / 21600)::BIGINT), q AS (SELECT 'off' AS sqi, * FROM pt UNION ALL SELECT 'on', * FROM pt WHERE ok),
o AS (SELECT q.*, CASE WHEN t_s - lag(t_s) OVER (PARTITION BY sqi, rr_source, user_id ORDER BY t_s, event_id) > 43200 THEN 1 ELSE 0 END AS b FROM q JOIN th ON th.patient_id = q.user_id % 10 WHERE v > thr), i AS (SELECT *, sum(b) OVER (PARTITION BY sqi, rr_source, user_id ORDER BY t_s, event_id) AS isl FROM o),
f0 AS (SELECT rr_source, sqi, user_id, min(t_s) AS f0, max(t_s) AS f1, max(v) AS peak, count(*) AS n_points FROM i GROUP BY rr_source, sqi, user_id, isl), s0 AS (SELECT DISTINCT q.rr_source, q.sqi, tr.* FROM truth tr JOIN q USING (user_id)), hr AS (SELECT count(*) * 6.0 AS hours FROM win)"""


def study_result(spark, sf_dir) -> dict:
    """The detection study over events: a recording is a user, ten of which make a patient; of two beat sources the first one calibrates."""
    e = events_table(spark, sf_dir)
    start = e.groupBy("user_id").agg(F.min("t").alias("_first"))
    x = e.join(start, "user_id").withColumn("rel", F.col("t") - F.col("_first"))
    ids = [F.col("user_id").alias("recording_uid"), (F.col("user_id") % 10).alias("patient_id"), F.when(F.col("user_id") % 3 == 0, "a").when(F.col("user_id") % 3 == 1, "b").alias("enrollment_id"), F.col("user_id").alias("recording_id")]
    recordings = start.select(*ids)
    beats = intervals(spark, sf_dir).withColumn("ord", F.row_number().over(B.series(USER, ORDER)))
    pairs = beats.select(*ids[1:], F.lit("algo").alias("algo_id"), "ord", F.col("rr").alias("rr_labview_s"), (F.col("rr") + F.col("event_id") % 7).alias("rr_python_s"))
    w = x.groupBy(F.col("user_id").alias("recording_uid"), F.floor(F.col("rel") / (6 * HOUR)).cast("bigint").alias("window_idx")).agg((F.max("value") <= 150).alias("is_acceptable"))
    w = w.withColumns({"win_start_s": F.col("window_idx") * 21600.0, "win_end_s": (F.col("window_idx") + 1) * 21600.0})
    seizures = x.where("event_type = 'error' and value > 150").select(F.col("user_id").alias("recording_uid"), (F.col("rel") - 300).alias("t0"), (F.col("rel") + 300).alias("t1"))
    cfg = studies.DetectionConfig(n_beats=N, gap_s=12 * HOUR, pad_s=6 * HOUR, segments=(("first_20d", 1728000.0), ("first_14d", 1209600.0), ("first_half", None)), responders=(0, 3, 6, 9))
    return studies.detection_study(pairs, recordings, w, seizures, cfg)


RESPONDERS = "JOIN (VALUES ('all'), ('true'), ('false')) g(is_responder) ON g.is_responder = 'all' OR (g.is_responder = 'true') = (user_id % 10 IN (0, 3, 6, 9))"
COUNTS_SQL = """hit AS (SELECT {by}, count(*) AS n_true, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM f0 WHERE f0.rr_source = s0.rr_source AND f0.sqi = s0.sqi AND f0.user_id = s0.user_id AND f0 <= t1 + 21600 AND f1 >= t0 - 21600)) AS n_detected FROM s0 {join} GROUP BY ALL),
false_ AS (SELECT {by}, count(*) AS n_events, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM s0 WHERE s0.rr_source = f0.rr_source AND s0.sqi = f0.sqi AND s0.user_id = f0.user_id AND f0 <= t1 + 21600 AND f1 >= t0 - 21600)) AS n_false FROM f0 {join} GROUP BY ALL)
SELECT {by}, coalesce(n_events, 0) AS n_events, coalesce(n_true, 0) AS n_true, coalesce(n_detected, 0) AS n_detected, coalesce(n_false, 0) AS n_false, round(n_detected / nullif(n_true, 0), 6) AS recall, round(coalesce(n_false, 0) / hours, 6) AS far_per_h FROM hit FULL JOIN false_ USING ({by}), hr"""


@query("detection_study", f"{STUDY}, {COUNTS_SQL.format(by='rr_source, sqi', join='')}")
def detection_study(spark, sf_dir):
    """Windows and their overlap with annotated events, features, calibrated thresholds, events with and without the quality mask, scores."""
    x = study_result(spark, sf_dir)["scores"]
    return rounded(x.select("rr_source", "sqi", "n_events", "n_true", "n_detected", "n_false", "recall", "far_per_h"), "recall", "far_per_h")


@query("detection_responders", f"{STUDY}, {COUNTS_SQL.format(by='rr_source, sqi, is_responder', join=RESPONDERS)}")
def detection_responders(spark, sf_dir):
    x = study_result(spark, sf_dir)["responder_scores"]
    return rounded(x.select("rr_source", "sqi", "is_responder", "n_events", "n_true", "n_detected", "n_false", "recall", "far_per_h"), "recall", "far_per_h")


@query("detection_events", f"{STUDY} SELECT rr_source, sqi, user_id AS recording_uid, round(f0, 3) AS t_start, round(f1, 3) AS t_end, round(peak, 3) AS peak_value, n_points FROM f0")
def detection_events(spark, sf_dir):
    x = study_result(spark, sf_dir)["events"]
    return rounded(x.select("rr_source", "sqi", "recording_uid", "t_start", "t_end", "peak_value", "n_points"), "t_start", "t_end", "peak_value", digits=3)

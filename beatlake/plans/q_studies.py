"""Whole studies, and operators on annotations, matches and slices that they are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatlake.functions.scalars import duration_text, scaled_round
from beatlake.operators import audit as A
from beatlake.operators import beats as B
from beatlake.operators import matching as M
from beatlake.operators import segments as G
from beatlake.operators import signal as S
from beatlake.plans import studies
from beatlake.plans.q_beats import FRAME, ORDER, RR, W, intervals
from beatlake.plans.q_events import HOUR, PAIR, SWEEP, USER, rates_sql, trains, walk_sql
from beatlake.plans.q_quality import SIGNAL, STATS, WIN, flagged, six_hours
from beatlake.plans.q_quality import signal as prices
from beatlake.plans.q_signal import FS, KEY, X
from beatlake.plans.q_signal import segments as vectors
from beatlake.plans.registry import E, events_table, query, rounded, table
from beatlake.schema import coerce_keys
from beatlake.sources import text as T


@query("detector_ranking", f"{SWEEP}, {rates_sql('tol_s')} SELECT tol_s, tp, fn, fp, round(f1, 6) AS f1, row_number() OVER (ORDER BY f1 DESC NULLS LAST, tol_s) AS rank FROM g")
def detector_ranking(spark, sf_dir):
    a, b = trains(spark, sf_dir)
    x = M.pooled(M.tolerance_sweep(a, b, USER, "t", [HOUR, 6 * HOUR]), ["tol_s"])
    return rounded(M.ranked(x, ["tol_s"]).select("tol_s", "tp", "fn", "fp", "f1", "rank"), "f1")


CUTS = (0, 10, 20, 40)
VARIANTS = f"""WITH RECURSIVE {E}, v(c) AS (VALUES {", ".join(f"({c})" for c in CUTS)}), a AS (SELECT user_id * 100 + c AS user_id, t, row_number() OVER (PARTITION BY user_id, c ORDER BY t) AS i FROM e, v WHERE event_type = 'click'), b AS (SELECT user_id * 100 + c AS user_id, t, row_number() OVER (PARTITION BY user_id, c ORDER BY t) AS j FROM e, v WHERE event_type = 'view' AND value > c), {walk_sql("21600.0")}"""


@query("variant_ranking", f"{VARIANTS}, g AS (SELECT user_id % 100 AS cut, count(*) FILTER (WHERE kind = 'TP') AS tp, count(*) FILTER (WHERE kind = 'FN') AS fn, count(*) FILTER (WHERE kind = 'FP') AS fp FROM mt GROUP BY 1) SELECT cut::INT AS cut, tp, fn, fp, round(2 * tp / nullif(2 * tp + fn + fp, 0), 6) AS f1, row_number() OVER (ORDER BY 2 * tp / nullif(2 * tp + fn + fp, 0) DESC NULLS LAST, cut)::INT AS rank FROM g")
def variant_ranking(spark, sf_dir):
    """Detectors with different thresholds, ranked by the beats they find."""
    a, e = trains(spark, sf_dir)[0], events_table(spark, sf_dir).where("event_type = 'view'")
    tests = e.withColumn("cut", F.explode(F.array(*map(F.lit, CUTS)))).where(F.col("value") > F.col("cut")).select("user_id", "cut", "t")
    return rounded(studies.rank_detectors(a, tests, USER, ["cut"], "t", 6 * HOUR).select("cut", "tp", "fn", "fp", "f1", "rank"), "f1")


VERSIONS = f"""WITH RECURSIVE {E}, r AS (SELECT user_id, event_type, t, t - lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t) AS rr FROM e WHERE event_type IN ('click', 'view')), o AS (SELECT i AS rank, (i - 8) * 3600.0::DOUBLE AS off FROM range(17) t(i)),
h AS (SELECT a.user_id, rank, off, count(*) AS n, round(avg(abs(a.rr - b.rr) * 1000), 9) AS mae FROM r a JOIN r b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND a.rr IS NOT NULL AND b.rr IS NOT NULL JOIN o ON abs(b.t + off - a.t) <= 10800.000000001 GROUP BY ALL HAVING count(*) >= 2),
best AS (SELECT user_id, off, mae, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mae, rank) AS rn FROM h) WHERE rn = 1),
a AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM r WHERE event_type = 'click' AND rr IS NOT NULL), b AS (SELECT r.user_id, r.t + coalesce(off, 0) AS t, row_number() OVER (PARTITION BY r.user_id ORDER BY r.t) AS j FROM r LEFT JOIN best USING (user_id) WHERE event_type = 'view' AND rr IS NOT NULL), {walk_sql("7200.0")}"""


@query("compare_versions", f"{VERSIONS}, {rates_sql('user_id')} SELECT g.user_id, tp, fn, fp, round(sens, 6) AS sens, round(ppv, 6) AS ppv, round(f1, 6) AS f1, coalesce(off, 0) AS best_delta, round(mae, 2) AS rr_mae_ms, coalesce(n, 0) AS n_common FROM g LEFT JOIN best USING (user_id)")
def compare_versions(spark, sf_dir):
    """Two versions of a recording's beats: best shift of their intervals, then the match of the beats."""
    a, b = (B.rr_from_peaks(x, USER, ["t"]) for x in trains(spark, sf_dir))
    x = studies.compare_versions(a, b, USER, "t", "rr", [(i - 8) * HOUR for i in range(17)], 3 * HOUR, 2 * HOUR, 2)
    return rounded(x, "sens", "ppv", "f1").withColumn("rr_mae_ms", scaled_round(F.col("rr_mae_ms"), 2))


@query("refined_shift", f"{PAIR}, {walk_sql('21600.0')} SELECT user_id, round(CASE WHEN count(*) >= 3 THEN greatest(least(median(t_test - t_ref), 1800), -1800) ELSE 0 END, 6) AS delta FROM mt WHERE kind = 'TP' GROUP BY 1")
def refined_shift(spark, sf_dir):
    a, b = trains(spark, sf_dir)
    return rounded(M.refined_shift(M.greedy_match(a, b, USER, "t", 6 * HOUR), USER, HOUR / 2, 3), "delta")


@query("peak_comparison")
def peak_comparison(spark, sf_dir):
    """Two methods' events of all recordings against the same reference, compared at once."""
    e = events_table(spark, sf_dir)
    test = e.where(F.col("event_type").isin("view", "purchase")).select("user_id", F.col("event_type").alias("method"), "t")
    ref = e.where("event_type = 'click'").select("user_id", F.explode(F.array(F.lit("view"), F.lit("purchase"))).alias("method"), "t")
    x = studies.compare_peaks(ref, test, ["user_id", "method"], tol=6 * HOUR)["metrics"]
    return rounded(rounded(x, "sens", "ppv", "f1"), "median_dt_ms", "p95_abs_dt_ms", digits=3)


#: An annotated event in each recording of q_quality's windows, ten seconds a window.
RETENTION = f"""{STATS}, v AS (SELECT rec AS recording_uid, window_idx, window_idx * 10.0::DOUBLE AS a, window_idx * 10.0::DOUBLE + 10 AS b, NOT (is_flatline OR is_noiseburst OR is_clipping) AS ok, is_flatline, is_noiseburst, is_clipping FROM f),
tr AS (SELECT s_suppkey AS recording_uid, 30.0::DOUBLE + s_suppkey % 50 AS t0, 45.0::DOUBLE + s_suppkey % 50 AS t1 FROM supplier), o AS (SELECT v.*, EXISTS (SELECT 1 FROM tr WHERE tr.recording_uid = v.recording_uid AND a < t1 AND b > t0) AS ev FROM v)"""


def retention(spark, sf_dir):
    w = flagged(spark, sf_dir).withColumnRenamed("rec", "recording_uid").withColumns({"win_start_s": F.col("window_idx") * 10.0, "win_end_s": F.col("window_idx") * 10.0 + 10})
    onset = F.col("s_suppkey") % 50
    truth = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("recording_uid"), (30.0 + onset).alias("t0"), (45.0 + onset).alias("t1"))
    return studies.retention_study(w, truth)


@query("retention_study", f"{RETENTION} SELECT recording_uid, count(*) AS n_all, count(*) FILTER (WHERE ok) AS kept_all, count(*) FILTER (WHERE ev) AS n_event, count(*) FILTER (WHERE ev AND ok) AS kept_event, round(avg(ok::INT), 6) AS share_all, round(avg(ok::INT) FILTER (WHERE NOT ev), 6) AS share_baseline FROM o GROUP BY 1")
def retention_study(spark, sf_dir):
    x = retention(spark, sf_dir)["by_recording"].select("recording_uid", "n_all", "kept_all", "n_event", "kept_event", "share_all", "share_baseline")
    return rounded(x, "share_all", "share_baseline")


@query("retention_study_events", f"{RETENTION} SELECT recording_uid, t0, t1, count(*) AS n_windows, count(*) FILTER (WHERE ok) AS n_kept FROM v JOIN tr USING (recording_uid) WHERE a < t1 AND b > t0 GROUP BY ALL")
def retention_study_events(spark, sf_dir):
    return retention(spark, sf_dir)["by_event"].select("recording_uid", "t0", "t1", "n_windows", "n_kept")


@query("retention_study_flags", f"""{RETENTION}, g AS (SELECT unnest(['all', CASE WHEN ev THEN 'event' ELSE 'baseline' END]) AS "group", is_flatline, is_noiseburst, is_clipping FROM o)
SELECT "group", count(*) AS n_windows, round(avg(is_flatline::INT), 6) AS frac_is_flatline, round(avg(is_noiseburst::INT), 6) AS frac_is_noiseburst, round(avg(is_clipping::INT), 6) AS frac_is_clipping FROM g GROUP BY 1""")
def retention_study_flags(spark, sf_dir):
    return rounded(retention(spark, sf_dir)["flags"], "frac_is_flatline", "frac_is_noiseburst", "frac_is_clipping")


@query("trim_table", f"""WITH {SIGNAL}, w AS (SELECT rec, i // 10 AS k, sqrt(avg(x * x)) AS rms FROM s GROUP BY 1, 2), c AS (SELECT *, median(rms) OVER (PARTITION BY rec) AS m, min(k) OVER (PARTITION BY rec) AS lo, max(k) OVER (PARTITION BY rec) AS hi FROM w),
g AS (SELECT *, k - row_number() OVER (PARTITION BY rec ORDER BY k) AS g FROM c WHERE rms <= 1.05 * m), r AS (SELECT rec, min(k) AS a, max(k) AS b FROM g GROUP BY rec, g HAVING count(*) >= 2), o AS (SELECT DISTINCT rec, lo, hi FROM c)
SELECT o.rec AS rec, coalesce(min(a) FILTER (WHERE a <= lo + 5), 0) * 10.0::DOUBLE AS trim_start_s, (hi - coalesce(max(b) FILTER (WHERE b >= hi - 5), hi)) * 10.0::DOUBLE AS trim_end_s FROM o LEFT JOIN r ON r.rec = o.rec GROUP BY o.rec, hi""")
def trim_table(spark, sf_dir):
    chunks = G.chunked(prices(spark, sf_dir), ["rec"], "i", "x", 64)
    return studies.trim_table(chunks, ["rec"], 1.0, 10.0, 1.05, 2, 5).select("rec", "trim_start_s", "trim_end_s")


@query("slices", f"WITH {SIGNAL}, p AS (SELECT rec, i, x, span FROM s, (VALUES (0), (1)) v(span) WHERE i >= 40 * span + rec % 7 AND i < 40 * span + 100 + rec % 5) SELECT rec, span, count(*) AS n, round(sum(x), 2) AS total, round(min_by(x, i), 2) AS first_value FROM p GROUP BY 1, 2")
def slices(spark, sf_dir):
    s = prices(spark, sf_dir)
    spans = s.select("rec").distinct().withColumn("span", F.explode(F.array(F.lit(0), F.lit(1))))
    spans = spans.withColumns({"i0": 40 * F.col("span") + F.col("rec") % 7, "i1": 40 * F.col("span") + 100 + F.col("rec") % 5})
    x = G.slices(G.chunked(s, ["rec"], "i", "x", 64), spans, ["rec"], ["span"], "i0", "i1")
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v)
    return x.select("rec", "span", F.size("samples").alias("n"), F.round(total, 2).alias("total"), F.round(F.col("samples")[0], 2).alias("first_value"))


@query("trim_samples", f"WITH {X} SELECT vec_id, len(x[17:57]) AS n_round, round(list_sum(x[17:57]), 8) AS sum_round, len(x[16:57]) AS n_cut, round(list_sum(x[16:57]), 8) AS sum_cut FROM x")
def trim_samples(spark, sf_dir):
    total = lambda x: F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 8)
    whole, cut = (G.trim_samples(F.col("samples"), FS, 15.5 / FS, 7 / FS, m) for m in ("round", "cut"))
    return vectors(spark, sf_dir).select("vec_id", F.size(whole).alias("n_round"), total(whole).alias("sum_round"), F.size(cut).alias("n_cut"), total(cut).alias("sum_cut"))


@query("valid_peri", f"WITH {WIN} SELECT user_id, window_idx, n, CASE WHEN ev THEN 'ictal' ELSE 'baseline' END AS role FROM w WHERE CASE WHEN ev THEN n >= 1 ELSE n >= 2 END")
def valid_peri(spark, sf_dir):
    w = six_hours(spark, sf_dir).withColumn("role", F.when(F.col("ev"), "ictal").otherwise("baseline"))
    return A.valid_peri(w, "role", F.col("n"), 1, 2).select("user_id", "window_idx", "n", "role")


@query("rr_median7_edge", f"""WITH {RR}, x AS (SELECT *, list(rr) {FRAME.format('3 PRECEDING', '3 FOLLOWING')} AS near, count(*) OVER (PARTITION BY user_id, event_type) AS n, row_number() OVER {W} AS i, first_value(rr) {FRAME.format('UNBOUNDED PRECEDING', 'UNBOUNDED FOLLOWING')} AS f, last_value(rr) {FRAME.format('UNBOUNDED PRECEDING', 'UNBOUNDED FOLLOWING')} AS l FROM rr)
SELECT user_id, event_id, round(list_sort(list_concat(list_concat([f FOR _ IN range(greatest(4 - i, 0))], near), [l FOR _ IN range(greatest(3 - (n - i), 0))]))[4], 6) AS rr_med FROM x""".replace("PARTITION BY user_id ORDER", "PARTITION BY user_id, event_type ORDER").replace("lag(t) OVER (PARTITION BY user_id, event_type", "lag(t) OVER (PARTITION BY user_id"))
def rr_median7_edge(spark, sf_dir):
    x = B.median_beats(intervals(spark, sf_dir), ["user_id", "event_type"], ORDER, mode="edge_always")
    return rounded(x.select("user_id", "event_id", "rr_med"), "rr_med")


@query("segment_cumsum", f"WITH {RR} SELECT user_id, event_type, event_id, round(sum(rr) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 6) AS t_beat FROM rr")
def segment_cumsum(spark, sf_dir):
    x = B.time_from_rr(intervals(spark, sf_dir), ["user_id", "event_type"], ORDER)
    return rounded(x.select("user_id", "event_type", "event_id", "t_beat"), "t_beat")


@query("composite_sqi", """WITH u AS (SELECT l_orderkey, l_linenumber, l_quantity * 0.5::DOUBLE AS snr, l_discount * 6.0::DOUBLE AS base, l_tax * 3.0::DOUBLE AS line, l_discount * 4.0::DOUBLE AS flat, l_tax * 1.5::DOUBLE AS clip FROM lineitem), n AS (SELECT l_orderkey, l_linenumber,
least(greatest(snr / 20, 0), 1) AS a, least(greatest((base - 0.05) / 0.45, 0), 1) AS b, least(greatest((line - 0.01) / 0.19, 0), 1) AS c, least(greatest(flat / 0.3, 0), 1) AS d, least(greatest(clip / 0.1, 0), 1) AS e FROM u)
SELECT l_orderkey, l_linenumber, round(0.4 * a + 0.2 * (1 - b) + 0.15 * (1 - c) + 0.15 * (1 - d) + 0.1 * (1 - e), 6) AS sqi FROM n""")
def composite_sqi(spark, sf_dir):
    sqi = S.composite_sqi(F.col("l_quantity") * 0.5, F.col("l_discount") * 6.0, F.col("l_tax") * 3.0, F.col("l_discount") * 4.0, F.col("l_tax") * 1.5)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(sqi, 6).alias("sqi"))


@query("signal_lag", f"""WITH {X}, y AS (SELECT vec_id, [v - list_avg(x) FOR v IN x] AS a FROM x), r AS (SELECT vec_id, a, list_concat(a[59:64], a[1:58]) AS b FROM y), c AS (SELECT vec_id, k, list_sum([a[n] * b[n + k] FOR n IN range(greatest(1, 1 - k), least(64, 64 - k) + 1)]) AS c FROM r, (SELECT unnest(range(-63, 64)) AS k))
SELECT vec_id, max_by(k, c) AS lag FROM c GROUP BY 1""")
def signal_lag(spark, sf_dir):
    x = vectors(spark, sf_dir).withColumn("moved", F.concat(F.slice("samples", 59, 6), F.slice("samples", 1, 58)))
    return S.lag_between(x, KEY, "samples", "moved")


@query("preferred_events", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'eeg' ELSE 'clinical' END AS source, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate ELSE o_orderdate + INTERVAL 1 DAY END AS start FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")
def preferred_events(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    later = day + F.make_dt_interval(F.lit(1))
    wide = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 == 0, day).alias("eeg_start"), F.when(k % 3 == 0, later).alias("eeg_end"), F.when(k % 5 == 0, later).alias("clinical_start"), F.when(k % 5 == 0, later).alias("clinical_end"))
    return T.preferred_events(T.annotations_long(wide, ["o_orderkey"]), ["o_orderkey"]).select("o_orderkey", "source", "start")


@query("normalised_annotations", """WITH r AS (SELECT s_nationkey::VARCHAR AS path, s_nationkey % 2 = 0 AS num, s_suppkey AS k, TIMESTAMP '2024-01-02 03:00:00' + INTERVAL 1 SECOND * (s_suppkey % 3600) AS ts FROM supplier)
SELECT path, CASE WHEN num THEN k + 0.5 END::DOUBLE AS start_s, CASE WHEN num THEN CASE WHEN k % 3 = 0 THEN k + 9.25 ELSE k + 30.5 END END::DOUBLE AS end_s, CASE WHEN NOT num THEN ts END AS start_ts, CASE WHEN NOT num THEN ts + INTERVAL 30 SECOND END AS end_ts FROM r""")
def normalised_annotations(spark, sf_dir):
    k, num = F.col("s_suppkey"), F.col("s_nationkey") % 2 == 0
    stamp = F.date_format(F.timestamp_micros(F.lit(1_704_164_400_000_000) + (k % 3600) * 1_000_000), "dd-MM-yyyy HH:mm:ss")
    raw = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("path"), F.when(num, F.concat(k.cast("string"), F.lit(",5"))).otherwise(stamp).alias("Anfaldsstart"), F.when(num & (k % 3 == 0), F.concat((k + 9).cast("string"), F.lit(".25"))).alias("Anfaldsslut"))
    return T.normalise_annotations(raw)


@query("rows_below_header", """WITH r AS (SELECT s_nationkey::VARCHAR AS path, s_nationkey AS nation, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS line, s_name, s_suppkey::VARCHAR AS k FROM supplier), h AS (SELECT path, line AS head FROM r WHERE line = 1 + nation % 12 AND line <= 10)
SELECT path, line, unnest(['Start tid', 'Varighed']) AS name, unnest([s_name, k]) AS cell FROM r JOIN h USING (path) WHERE line > head""")
def rows_below_header(spark, sf_dir):
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    s = table(spark, sf_dir, "supplier").withColumn("line", nth)
    head = F.array(F.lit(" Start tid"), F.lit("Varighed"))
    rows = s.select(F.col("s_nationkey").cast("string").alias("path"), "line", F.when(F.col("line") == 1 + F.col("s_nationkey") % 12, head).otherwise(F.array("s_name", F.col("s_suppkey").cast("string"))).alias("cells"))
    return T.below_header(rows, ("start",), ("varighed", "duration"))


@query("coerced_keys", "SELECT try_cast(CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE '' END || o_orderkey AS BIGINT) AS k, o_custkey FROM orders WHERE o_orderkey % 7 <> 0")
def coerced_keys(spark, sf_dir):
    k = F.concat(F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(""), F.col("o_orderkey").cast("string"))
    return coerce_keys(table(spark, sf_dir, "orders").select(k.alias("k"), "o_custkey"), "k")


@query("duration_text", f"WITH {E} SELECT event_id, printf('%02d:%02d:%02d', floor(t / 3600)::BIGINT, floor(t / 60)::BIGINT % 60, floor(t)::BIGINT % 60) AS clock FROM e")
def durations(spark, sf_dir):
    return events_table(spark, sf_dir).select("event_id", duration_text(F.col("t")).alias("clock"))


@query("detector_variants")
def detector_variants(spark, sf_dir):
    x, out = vectors(spark, sf_dir), None
    for method in ("two_level", "high_only", "energy", "prominence"):
        one = S.detect_peaks(x, KEY, "samples", FS, method).withColumn("method", F.lit(method))
        out = one if out is None else out.unionByName(one)
    return out


@query("amplitude_ratio")
def amplitude_ratio(spark, sf_dir):
    return rounded(S.amplitude_ratio(vectors(spark, sf_dir), KEY, "samples", FS), "rt_ratio")


@query("wavelet_band")
def wavelet_band(spark, sf_dir):
    x = S.wavelet_band(vectors(spark, sf_dir), KEY, "samples", 1, 3)
    return x.select("vec_id", F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v * v), 6).alias("energy"))


@query("labelled_noise")
def labelled_noise(spark, sf_dir):
    x = vectors(spark, sf_dir).select((F.col("vec_id") % 97).alias("rec"), F.col("vec_id").alias("window_idx"), (F.col("label") % 3 + 1).cast("int").alias("label"), "samples")
    return studies.labelled_noise(x.drop("label"), x.select("rec", "window_idx", "label"), ["rec"], FS)

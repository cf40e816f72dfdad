"""Events, intervals and matching over the event table: a recording is a user."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatlake.functions.scalars import scaled_round
from beatlake.operators import events as V
from beatlake.operators import intervals as I
from beatlake.operators import matching as M
from beatlake.operators.segments import segment_index, shifted_windows, peri_windows
from beatlake.plans.registry import E, events_table, query, rounded, table
from beatlake.schema import dedup_first, duplicates

USER, ORDER = ["user_id"], ["event_id"]
HOUR = 3600.0
#: Blocks of time that long recordings are cut into.
BLOCK = 5 * 24 * HOUR
#: Annotated events: five minutes around each error.
TRUTH = "truth AS (SELECT user_id, event_id AS seizure_id, t, t - 300 AS t0, t + 300 AS t1 FROM e WHERE event_type = 'error')"
ISLANDS = """o AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 43200 THEN 1 ELSE 0 END AS b FROM e WHERE value > 20), i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t, event_id) AS isl FROM o),
ev AS (SELECT user_id, min(t) AS t_start, max(t) AS t_end, max(value) AS peak_value, min_by(t, (-value, t)) AS t_peak, count(*) AS n_points FROM i GROUP BY user_id, isl)"""


def truth(spark, sf_dir):
    e = events_table(spark, sf_dir).where("event_type = 'error'")
    return e.select("user_id", F.col("event_id").alias("seizure_id"), "t", (F.col("t") - 300).alias("t0"), (F.col("t") + 300).alias("t1"))


def islands(spark, sf_dir, block=None):
    return V.event_list(events_table(spark, sf_dir), USER, ORDER, "t", "value", 20.0, gap=12 * HOUR, block=block)


@query("threshold_events", f"WITH {E}, {ISLANDS} SELECT user_id, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end, round(t_end - t_start, 6) AS duration_s, round(t_peak, 6) AS t_peak, peak_value, n_points FROM ev")
def threshold_events(spark, sf_dir):
    return rounded(islands(spark, sf_dir, BLOCK), "t_start", "t_end", "duration_s", "t_peak")


@query("ordinal_events", f"""WITH {E}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS ord FROM e), f AS (SELECT *, CASE WHEN ord - lag(ord) OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 > 2 THEN 1 ELSE 0 END AS b FROM o WHERE value >= 25),
r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM f) SELECT user_id, min(ord) AS ord_start, max(ord) AS ord_end, count(*) AS n_points FROM r GROUP BY user_id, run""")
def ordinal_events(spark, sf_dir):
    return V.ordinal_events(events_table(spark, sf_dir), USER, ORDER, "t", F.col("value") >= 25, 2).select("user_id", "ord_start", "ord_end", "n_points")


@query("event_merge", f"""WITH {E}, iv AS (SELECT user_id, t - 21600 AS a, t + 21600 AS b FROM e WHERE event_type IN ('error', 'purchase')), m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM iv),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, round(min(a), 6) AS t_start, round(max(b), 6) AS t_end, count(*) AS n_merged FROM g GROUP BY user_id, k""")
def event_merge(spark, sf_dir):
    e = events_table(spark, sf_dir).where(F.col("event_type").isin("error", "purchase"))
    x = e.select("user_id", (F.col("t") - 6 * HOUR).alias("t_start"), (F.col("t") + 6 * HOUR).alias("t_end"))
    return rounded(V.merge_overlaps(x, USER, block=BLOCK), "t_start", "t_end")


@query("refractory_events", f"""WITH RECURSIVE {E}, s AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM e WHERE value > 10), k AS (SELECT user_id, t, i, t AS kept FROM s WHERE i = 1 UNION ALL
SELECT s.user_id, s.t, s.i, CASE WHEN s.t - k.kept >= 86400 THEN s.t ELSE k.kept END FROM k JOIN s ON s.user_id = k.user_id AND s.i = k.i + 1) SELECT DISTINCT user_id, round(kept, 6) AS t FROM k""")
def refractory_events(spark, sf_dir):
    return rounded(V.refractory(events_table(spark, sf_dir).where("value > 10"), USER, "t", 24 * HOUR, BLOCK), "t")


@query("refractory_islands", f"""WITH RECURSIVE {E}, {ISLANDS}, d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_peak) AS i FROM ev WHERE t_end - t_start >= 3600), k AS (SELECT user_id, t_peak, i, t_peak AS kept, n_points, t_start FROM d WHERE i = 1 UNION ALL
SELECT d.user_id, d.t_peak, d.i, CASE WHEN d.t_peak - k.kept >= 172800 THEN d.t_peak ELSE k.kept END, d.n_points, d.t_start FROM k JOIN d ON d.user_id = k.user_id AND d.i = k.i + 1) SELECT user_id, round(t_start, 6) AS t_start, round(t_peak, 6) AS t_peak, n_points FROM k WHERE t_peak = kept""")
def refractory_islands(spark, sf_dir):
    x = V.refractory_events(events_table(spark, sf_dir), USER, ORDER, "t", "value", 20.0, 12 * HOUR, HOUR, 48 * HOUR, BLOCK)
    return rounded(x.select("user_id", "t_start", "t_peak", "n_points"), "t_start", "t_peak")


@query("long_runs", f"""WITH {E}, s AS (SELECT *, value > 8 AS o, coalesce(t - lag(t) OVER w, 0) AS dt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), c AS (SELECT *, CASE WHEN o = coalesce(lag(o) OVER (PARTITION BY user_id ORDER BY t, event_id), NOT o) THEN 0 ELSE 1 END AS b FROM s),
r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM c) SELECT user_id, round(min(t), 6) AS t_start, round(sum(dt), 6) AS run_s, count(*) AS n_points FROM r WHERE o GROUP BY user_id, run HAVING sum(dt) >= 172800""")
def long_runs(spark, sf_dir):
    x = V.long_runs(events_table(spark, sf_dir), USER, ORDER, "t", F.col("value") > 8, 48 * HOUR)
    return rounded(x.select("user_id", "t_start", "run_s", "n_points"), "t_start", "run_s")


INDEXED = f"WITH {E}, x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS idx, value > 22 AS bad FROM e)"


def indexed(spark, sf_dir):
    from pyspark.sql import Window as W

    e = events_table(spark, sf_dir)
    return e.select("user_id", (F.row_number().over(W.partitionBy("user_id").orderBy("t", "event_id")) - 1).alias("idx"), (F.col("value") > 22).alias("bad"))


@query("bad_runs", f"{INDEXED}, g AS (SELECT *, idx - row_number() OVER (PARTITION BY user_id ORDER BY idx) AS g FROM x WHERE bad) SELECT user_id, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n FROM g GROUP BY user_id, g")
def bad_runs(spark, sf_dir):
    return V.index_runs(indexed(spark, sf_dir).where("bad"), USER, "idx").select("user_id", "first_idx", "last_idx", "n")


@query("trim_points", f"""{INDEXED}, g AS (SELECT *, idx - row_number() OVER (PARTITION BY user_id ORDER BY idx) AS g FROM x WHERE NOT bad), r AS (SELECT user_id, min(idx) AS a, max(idx) AS b, count(*) AS n FROM g GROUP BY user_id, g HAVING count(*) >= 3),
z AS (SELECT user_id, min(idx) AS lo, max(idx) AS hi FROM x GROUP BY 1) SELECT z.user_id, min(a) FILTER (WHERE a <= lo + 10) AS trim_first, max(b) FILTER (WHERE b >= hi - 10) AS trim_last FROM z LEFT JOIN r USING (user_id) GROUP BY z.user_id""")
def trim_points(spark, sf_dir):
    return V.trim_points(indexed(spark, sf_dir), USER, "idx", F.col("bad"), 3, 10)


ISI = f"WITH {E}, {TRUTH}, isi AS (SELECT user_id, seizure_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS isi_s FROM truth)"


@query("isi_per_recording", f"{ISI} SELECT user_id, seizure_id, round(isi_s, 6) AS isi_s FROM isi WHERE isi_s IS NOT NULL")
def isi_per_recording(spark, sf_dir):
    return rounded(V.inter_event_intervals(truth(spark, sf_dir), USER, "t").select("user_id", "seizure_id", "isi_s"), "isi_s")


@query("isi_summary", f"{ISI} SELECT user_id, count(isi_s) AS n, round(avg(isi_s), 3) AS mean, round(min(isi_s), 6) AS min, round(max(isi_s), 6) AS max, round(median(isi_s), 3) AS median, round(quantile_cont(isi_s, 0.75) - quantile_cont(isi_s, 0.25), 3) AS iqr FROM isi WHERE isi_s IS NOT NULL GROUP BY 1")
def isi_summary(spark, sf_dir):
    x = V.interval_summary(V.inter_event_intervals(truth(spark, sf_dir), USER, "t"), USER)
    return rounded(rounded(x, "min", "max"), "mean", "median", "iqr", digits=3)


@query("local_max_detector", f"""WITH RECURSIVE {E}, p AS (SELECT *, value > 15 AND value > lag(value) OVER w AND value >= lead(value) OVER w AS top FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), s AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM p WHERE top),
k AS (SELECT user_id, i, t AS kept FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.i, CASE WHEN s.t - k.kept >= 100000 THEN s.t ELSE k.kept END FROM k JOIN s ON s.user_id = k.user_id AND s.i = k.i + 1) SELECT DISTINCT user_id, round(kept, 6) AS t FROM k""")
def local_max_detector(spark, sf_dir):
    return rounded(V.local_peaks(events_table(spark, sf_dir), USER, ORDER, "t", "value", 15.0, 100_000.0), "t")


#: Windows of ten events of a user, from the first to the last.
WINDOWS = """r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i FROM e), win AS (SELECT user_id, i // 10 AS window_idx, min(t) AS w0, max(t) AS w1, stddev_pop(value) AS sd, max(value) - min(value) AS rg, count(*) AS n FROM r GROUP BY 1, 2)"""


def windows(spark, sf_dir):
    from pyspark.sql import Window as W

    e = events_table(spark, sf_dir).withColumn("i", F.row_number().over(W.partitionBy("user_id").orderBy("t", "event_id")) - 1)
    g = e.groupBy("user_id", F.floor(F.col("i") / 10).cast("bigint").alias("window_idx"))
    return g.agg(F.min("t").alias("w0"), F.max("t").alias("w1"), F.stddev_pop("value").alias("sd"), (F.max("value") - F.min("value")).alias("rg"), F.count("*").alias("n"))


for _name, _closed in (("window_overlap_strict", False), ("window_overlap_closed", True)):
    _lt = "<=" if _closed else "<"

    @query(_name, f"WITH {E}, {TRUTH}, {WINDOWS} SELECT user_id, window_idx, EXISTS (SELECT 1 FROM truth s WHERE s.user_id = win.user_id AND win.w0 {_lt} s.t1 AND s.t0 {_lt} win.w1) AS overlaps_event FROM win")
    def window_overlap(spark, sf_dir, closed=_closed):
        x = I.overlap_flag(windows(spark, sf_dir), truth(spark, sf_dir), USER, ["window_idx"], ("w0", "w1"), ("t0", "t1"), closed)
        return x.select("user_id", "window_idx", "overlaps_event")


@query("windows_by_event", f"WITH {E}, {TRUTH}, {WINDOWS} SELECT user_id, seizure_id, count(*) AS n_windows, sum(n) AS n_points FROM win JOIN truth s USING (user_id) WHERE w0 < t1 AND w1 > t0 GROUP BY 1, 2")
def windows_by_event(spark, sf_dir):
    x = I.overlap_pairs(windows(spark, sf_dir), truth(spark, sf_dir), USER, ("w0", "w1"), ("t0", "t1"))
    return x.groupBy("user_id", "seizure_id").agg(F.count("*").alias("n_windows"), F.sum("n").alias("n_points"))


@query("asof_window_map", f"""WITH {E}, w AS (SELECT user_id, event_id AS wid, t AS s, t + 43200 AS en FROM e WHERE event_type = 'error'), p AS (SELECT user_id, event_id, t FROM e WHERE event_type <> 'error')
SELECT p.user_id, p.event_id, w.wid FROM p ASOF JOIN w ON p.user_id = w.user_id AND p.t >= w.s WHERE p.t < w.en""")
def asof_window_map(spark, sf_dir):
    e = events_table(spark, sf_dir)
    w = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("wid"), F.col("t").alias("s"), (F.col("t") + 12 * HOUR).alias("en"))
    return I.asof_window(e.where("event_type <> 'error'").select("user_id", "event_id", "t"), w, USER, "t", "s", "en", ["wid"], ["event_id"], BLOCK).select("user_id", "event_id", "wid")


@query("floor_window_join", f"""WITH {E}, f AS (SELECT *, t - min(t) OVER (PARTITION BY user_id) AS x FROM e), w AS (SELECT user_id, floor(x / 21600)::BIGINT AS window_idx, avg(value) AS m FROM f WHERE event_type = 'view' GROUP BY 1, 2)
SELECT f.user_id, f.event_id, floor(x / 21600)::BIGINT AS window_idx, round(w.m, 4) AS m FROM f LEFT JOIN w ON w.user_id = f.user_id AND w.window_idx = floor(x / 21600)::BIGINT""")
def floor_window_join(spark, sf_dir):
    from pyspark.sql import Window as W

    e = events_table(spark, sf_dir).withColumn("x", F.col("t") - F.min("t").over(W.partitionBy("user_id")))
    w = e.where("event_type = 'view'").groupBy("user_id", F.floor(F.col("x") / (6 * HOUR)).cast("bigint").alias("window_idx")).agg(F.avg("value").alias("m"))
    return rounded(I.floor_window(e, w, USER, "x", 6 * HOUR, ["m"]).select("user_id", "event_id", "window_idx", "m"), "m", digits=4)


@query("nearest_tolerance_join", f"""WITH {E}, a AS (SELECT * FROM e WHERE event_type = 'click'), b AS (SELECT * FROM e WHERE event_type = 'view'), j AS (SELECT a.user_id, a.event_id, b.t - a.t AS dt, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(b.t - a.t), b.t) AS rn FROM a JOIN b USING (user_id))
SELECT a.user_id, a.event_id, round(CASE WHEN abs(j.dt) <= 7200 THEN j.dt END, 6) AS dt FROM a LEFT JOIN j ON j.event_id = a.event_id AND rn = 1""")
def nearest_tolerance_join(spark, sf_dir):
    e = events_table(spark, sf_dir)
    x = I.nearest(e.where("event_type = 'click'"), e.where("event_type = 'view'"), USER, "t", "t", 2 * HOUR, block=BLOCK)
    return rounded(x.select("user_id", "event_id", "dt"), "dt")


@query("nearest_shift", f"""WITH {E}, a AS (SELECT * FROM e WHERE event_type = 'click'), b AS (SELECT * FROM e WHERE event_type = 'view'), j AS (SELECT a.user_id, b.t - a.t AS dt, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(b.t - a.t), b.t) AS rn FROM a JOIN b USING (user_id))
SELECT user_id, round(median(dt), 3) AS delta, count(*) AS n FROM j WHERE rn = 1 AND abs(dt) <= 36000 GROUP BY 1""")
def nearest_shift(spark, sf_dir):
    e = events_table(spark, sf_dir)
    x = I.nearest(e.where("event_type = 'click'"), e.where("event_type = 'view'"), USER, "t", "t", block=BLOCK)
    return rounded(M.nearest_shift(x, USER, 10 * HOUR), "delta", digits=3)


@query("point_in_interval", f"WITH {E}, {TRUTH} SELECT user_id, event_id, EXISTS (SELECT 1 FROM truth s WHERE s.user_id = e.user_id AND e.t BETWEEN s.t0 - 3600 AND s.t1 + 3600) AS inside FROM e WHERE event_type = 'purchase'")
def point_in_interval(spark, sf_dir):
    e = events_table(spark, sf_dir).where("event_type = 'purchase'")
    return I.points_in_intervals(e, truth(spark, sf_dir), USER, "t", ("t0", "t1"), HOUR).select("user_id", "event_id", "inside")


@query("coverage_fraction", f"""WITH {E}, {TRUTH}, {WINDOWS}, c AS (SELECT user_id, window_idx, sum(least(w1, t1) - greatest(w0, t0)) AS s FROM win JOIN truth USING (user_id) WHERE w0 < t1 AND w1 > t0 GROUP BY 1, 2)
SELECT user_id, window_idx, round(CASE WHEN w1 > w0 THEN coalesce(s, 0) / (w1 - w0) END, 6) AS coverage FROM win LEFT JOIN c USING (user_id, window_idx)""")
def coverage_fraction(spark, sf_dir):
    x = I.coverage(windows(spark, sf_dir), truth(spark, sf_dir), USER, ["window_idx"], ("w0", "w1"), ("t0", "t1"), block=BLOCK)
    return rounded(x.select("user_id", "window_idx", "coverage"), "coverage")


@query("null_safe_lookup", """WITH c AS (SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN NULL ELSE c_nationkey END AS k FROM customer), n AS (SELECT CASE WHEN n_nationkey < 5 THEN NULL ELSE n_nationkey END AS k, n_name, row_number() OVER (PARTITION BY CASE WHEN n_nationkey < 5 THEN NULL ELSE n_nationkey END ORDER BY n_nationkey) AS rn FROM nation)
SELECT c_custkey, n_name FROM c LEFT JOIN n ON c.k IS NOT DISTINCT FROM n.k AND rn = 1""")
def null_safe_lookup(spark, sf_dir):
    key = lambda c: F.when(F.col(c) >= 5, F.col(c)).alias("k")
    c = table(spark, sf_dir, "customer").select("c_custkey", key("c_nationkey"))
    n = table(spark, sf_dir, "nation").select(key("n_nationkey"), "n_name", "n_nationkey")
    return I.null_safe_lookup(c, n, ["k"], ["n_name"], ["n_nationkey"]).select("c_custkey", "n_name")


@query("customers_without_orders", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 400000)")
def customers_without_orders(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("membership_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) AND o_orderstatus IN ('F', 'O')")
def membership_filter(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    return o.join(c, o.o_custkey == c.c_custkey, "left_semi").select("o_orderkey", "o_custkey")


@query("dedup_first", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def first_order(spark, sf_dir):
    return dedup_first(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("duplicate_keys", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query("crop_to_common_range", f"""WITH {E}, a AS (SELECT * FROM e WHERE event_type = 'click'), b AS (SELECT * FROM e WHERE event_type = 'view'), r AS (SELECT user_id, greatest(min(a.t), min(b.t)) AS lo, least(max(a.t), max(b.t)) AS hi FROM a JOIN b USING (user_id) GROUP BY 1)
SELECT user_id, event_id FROM a JOIN r USING (user_id) WHERE lo <= hi AND t BETWEEN lo AND hi""")
def crop_to_common_range(spark, sf_dir):
    e = events_table(spark, sf_dir)
    a, b = e.where("event_type = 'click'"), e.where("event_type = 'view'")
    return I.crop(a, I.common_range(a, b, USER, "t"), USER, "t", "overlap_start", "overlap_end").select("user_id", "event_id")


PAIR = f"WITH RECURSIVE {E}, a AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM e WHERE event_type = 'click'), b AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS j FROM e WHERE event_type = 'view')"
WALK = f"""{PAIR}, u AS (SELECT DISTINCT user_id FROM a UNION SELECT DISTINCT user_id FROM b), k AS (SELECT user_id, 1 AS i, 1 AS j, 0 AS tp, 0.0::DOUBLE AS sum_dt FROM u UNION ALL
SELECT k.user_id, k.i + CASE WHEN b.t - a.t >= -21600.000000001 THEN 1 ELSE 0 END, k.j + CASE WHEN b.t - a.t <= 21600.000000001 THEN 1 ELSE 0 END, k.tp + CASE WHEN abs(b.t - a.t) <= 21600.000000001 THEN 1 ELSE 0 END, k.sum_dt + CASE WHEN abs(b.t - a.t) <= 21600.000000001 THEN b.t - a.t ELSE 0 END
FROM k JOIN a ON a.user_id = k.user_id AND a.i = k.i JOIN b ON b.user_id = k.user_id AND b.j = k.j), m AS (SELECT user_id, max(tp) AS tp, max_by(sum_dt, i + j) AS sum_dt FROM k GROUP BY 1),
n AS (SELECT user_id, count(a.t) AS na FROM u LEFT JOIN a USING (user_id) GROUP BY 1), o AS (SELECT user_id, count(b.t) AS nb FROM u LEFT JOIN b USING (user_id) GROUP BY 1)
SELECT user_id, tp, na - tp AS fn, nb - tp AS fp, round(tp / nullif(na, 0), 6) AS sens, round(tp / nullif(nb, 0), 6) AS ppv, round(2 * tp / nullif(na + nb, 0), 6) AS f1 FROM m JOIN n USING (user_id) JOIN o USING (user_id)"""


def walk_sql(tol: str) -> str:
    """Steps of the greedy match in SQL: the pair (i, j) that each step looks at and its time difference, by `tol` seconds."""
    return f"""u AS (SELECT DISTINCT user_id FROM a UNION SELECT DISTINCT user_id FROM b), k AS (SELECT user_id, 1 AS i, 1 AS j FROM u UNION ALL
SELECT k.user_id, k.i + CASE WHEN b.t - a.t >= -({tol}) - 1e-9 THEN 1 ELSE 0 END, k.j + CASE WHEN b.t - a.t <= {tol} + 1e-9 THEN 1 ELSE 0 END FROM k JOIN a ON a.user_id = k.user_id AND a.i = k.i JOIN b ON b.user_id = k.user_id AND b.j = k.j),
tp AS (SELECT a.user_id, a.t AS t_ref, b.t AS t_test, k.i, k.j FROM k JOIN a ON a.user_id = k.user_id AND a.i = k.i JOIN b ON b.user_id = k.user_id AND b.j = k.j WHERE abs(b.t - a.t) <= {tol} + 1e-9),
mt AS (SELECT user_id, 'TP' AS kind, t_ref, t_test FROM tp UNION ALL SELECT user_id, 'FN', t, NULL FROM a WHERE NOT EXISTS (SELECT 1 FROM tp WHERE tp.user_id = a.user_id AND tp.i = a.i) UNION ALL SELECT user_id, 'FP', NULL, t FROM b WHERE NOT EXISTS (SELECT 1 FROM tp WHERE tp.user_id = b.user_id AND tp.j = b.j))"""


def rates_sql(by: str) -> str:
    n = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k.lower()}" for k in ("TP", "FN", "FP"))
    return f"c AS (SELECT {by}, {n}, median((t_test - t_ref) * 1000) FILTER (WHERE kind = 'TP') AS md, quantile_cont(abs(t_test - t_ref) * 1000, 0.95) FILTER (WHERE kind = 'TP') AS p95 FROM mt GROUP BY ALL), g AS (SELECT *, tp / nullif(tp + fn, 0) AS sens, tp / nullif(tp + fp, 0) AS ppv, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM c)"


def trains(spark, sf_dir):
    e = events_table(spark, sf_dir)
    return e.where("event_type = 'click'").select("user_id", "t"), e.where("event_type = 'view'").select("user_id", "t")


@query("greedy_peak_match", WALK)
def greedy_peak_match(spark, sf_dir):
    a, b = trains(spark, sf_dir)
    x = M.metrics(M.greedy_match(a, b, USER, "t", 6 * HOUR), USER)
    return rounded(x.select("user_id", "tp", "fn", "fp", "sens", "ppv", "f1"), "sens", "ppv", "f1")


@query("band_match", f"WITH {E} SELECT a.user_id, round(a.t, 6) AS t_ref, round(b.t, 6) AS t_test FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND abs(b.t - a.t) <= 1800.000000001")
def band_match(spark, sf_dir):
    a, b = trains(spark, sf_dir)
    return rounded(M.band_match(a, b, USER, "t", 1800.0), "t_ref", "t_test")


@query("offset_grid_search", f"""WITH {E}, o AS (SELECT i AS rank, (i - 10) * 3600.0::DOUBLE AS off FROM range(21) t(i)), tp AS (SELECT a.user_id, rank, off, count(DISTINCT a.t) AS tp FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' JOIN o ON abs(b.t + off - a.t) <= 1800.000000001 GROUP BY ALL)
SELECT user_id, off AS best_offset, tp FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tp DESC, rank) AS rn FROM tp) WHERE rn = 1""")
def offset_grid_search(spark, sf_dir):
    a, b = trains(spark, sf_dir)
    return M.offset_search(a, b, USER, "t", [(i - 10) * HOUR for i in range(21)], 1800.0)


@query("offset_fine_search", f"""WITH {E}, p AS (SELECT a.user_id, a.t, unnest(range(greatest(ceil((a.t - b.t + 72000 - 900.000000001) / 12)::BIGINT, 0), least(floor((a.t - b.t + 72000 + 900.000000001) / 12)::BIGINT, 12000) + 1)) AS rank FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view'),
tp AS (SELECT user_id, rank, count(DISTINCT t) AS tp FROM p GROUP BY ALL) SELECT user_id, rank * 12.0::DOUBLE - 72000 AS best_offset, tp FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tp DESC, rank) AS rn FROM tp) WHERE rn = 1""")
def offset_fine_search(spark, sf_dir):
    """12,001 offsets, at the cost of 21."""
    a, b = trains(spark, sf_dir)
    return M.offset_search(a, b, USER, "t", [(i - 6000) * 12.0 for i in range(12001)], 900.0)


@query("rr_delta_search", f"""WITH {E}, r AS (SELECT user_id, event_type, t, t - lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t) AS rr FROM e WHERE event_type IN ('click', 'view')), o AS (SELECT i AS rank, (i - 4) * 7200.0::DOUBLE AS off FROM range(9) t(i)),
g AS (SELECT a.user_id, rank, off, count(*) AS n, round(avg(abs(a.rr - b.rr) * 1000), 9) AS mae FROM r a JOIN r b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND a.rr IS NOT NULL AND b.rr IS NOT NULL JOIN o ON abs(b.t + off - a.t) <= 10800.000000001 GROUP BY ALL HAVING count(*) >= 2)
SELECT user_id, off AS best_delta, round(mae, 2) AS mae_ms, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mae, rank) AS rn FROM g) WHERE rn = 1""")
def rr_delta_search(spark, sf_dir):
    from beatlake.operators.beats import rr_from_peaks

    a, b = (rr_from_peaks(x, USER, ["t"]) for x in trains(spark, sf_dir))
    x = M.rr_delta_search(a, b, USER, "t", "rr", [(i - 4) * 7200.0 for i in range(9)], 3 * HOUR, 2)
    return x.withColumn("mae_ms", scaled_round(F.col("mae_ms"), 2))


@query("lag_search", f"""WITH {E}, x AS (SELECT user_id, event_type, floor(t / 600)::BIGINT AS m FROM e), l AS (SELECT a.user_id, b.m - a.m AS lag, count(*) AS n FROM x a JOIN x b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND abs(b.m - a.m) <= 36 GROUP BY 1, 2)
SELECT user_id, lag, n AS coincidences FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, abs(lag), lag) AS rn FROM l) WHERE rn = 1""")
def lag_search(spark, sf_dir):
    a, b = (x.select("user_id", F.floor(F.col("t") / 600).cast("bigint").alias("m")) for x in trains(spark, sf_dir))
    return M.lag_search(a, b, USER, "m", 36)


@query("first_common_peak", f"WITH {E}, j AS (SELECT a.user_id, a.t AS ta, b.t AS tb, row_number() OVER (PARTITION BY a.user_id ORDER BY a.t, b.t) AS rn FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND abs(b.t - a.t) <= 7200.000000001) SELECT user_id, round(ta, 6) AS t_ref, round(tb, 6) AS t_test FROM j WHERE rn = 1")
def first_common_peak(spark, sf_dir):
    a, b = trains(spark, sf_dir)
    return rounded(M.first_common(a, b, USER, "t", 2 * HOUR), "t_ref", "t_test")


@query("rr_agreement", """WITH a AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, o_totalprice / 1e5 AS x FROM orders), b AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS i, o_totalprice / 1e5 AS y FROM orders)
SELECT k, count(*) AS n_common, round(avg(abs((y - x) * 1000)), 3) AS rr_mae_ms, round(sqrt(avg(((y - x) * 1000) * ((y - x) * 1000))), 3) AS rr_rmse_ms, round(60 / avg(x), 5) AS mean_hr_ref FROM a JOIN b USING (k, i) GROUP BY 1""")
def rr_agreement(spark, sf_dir):
    from pyspark.sql import Window as W

    o = table(spark, sf_dir, "orders")
    nth = lambda *by: F.row_number().over(W.partitionBy("o_custkey").orderBy(*by, "o_orderkey"))
    a = o.select(F.col("o_custkey").alias("k"), nth("o_orderdate").alias("i"), (F.col("o_totalprice") / 1e5).alias("x"))
    b = o.select(F.col("o_custkey").alias("k"), nth("o_totalprice").alias("i"), (F.col("o_totalprice") / 1e5).alias("y"))
    x = M.rr_agreement(a.join(b, ["k", "i"]), ["k"], "x", "y")
    return rounded(rounded(x.select("k", "n_common", "rr_mae_ms", "rr_rmse_ms", "mean_hr_ref"), "rr_mae_ms", "rr_rmse_ms", digits=3), "mean_hr_ref", digits=5)


@query("peak_error_log", f"{PAIR}, {walk_sql('21600.0')} SELECT user_id, kind AS error_type, round(coalesce(t_ref, t_test), 6) AS t_s, floor(coalesce(t_ref, t_test) / 3600)::BIGINT AS window_idx, 21600.0::DOUBLE AS tol_s, round((t_test - t_ref) * 1000, 3) AS dt_ms FROM mt")
def peak_error_log(spark, sf_dir):
    a, b = trains(spark, sf_dir)
    x = M.error_log(M.greedy_match(a, b, USER, "t", 6 * HOUR), HOUR, 6 * HOUR, with_tp=True)
    return rounded(rounded(x, "t_s"), "dt_ms", digits=3)


@query("minute_scores", f"{PAIR}, {walk_sql('21600.0')}, {rates_sql('user_id, floor(coalesce(t_ref, t_test) / 86400)::BIGINT AS bin')} SELECT user_id, bin, tp, fn, fp, round(sens, 6) AS sens, round(ppv, 6) AS ppv, round(f1, 6) AS f1 FROM g")
def minute_scores(spark, sf_dir):
    a, b = trains(spark, sf_dir)
    return rounded(M.minute_scores(M.greedy_match(a, b, USER, "t", 6 * HOUR), USER, 24 * HOUR), "sens", "ppv", "f1")


SWEEP = "WITH RECURSIVE " + E + ", v AS (SELECT * FROM (VALUES (3600.0::DOUBLE), (21600.0)) v(tol_s)), a AS (SELECT user_id, tol_s, t, row_number() OVER (PARTITION BY user_id, tol_s ORDER BY t) AS i FROM e, v WHERE event_type = 'click'), b AS (SELECT user_id, tol_s, t, row_number() OVER (PARTITION BY user_id, tol_s ORDER BY t) AS j FROM e, v WHERE event_type = 'view'), "
SWEEP += walk_sql("a.tol_s").replace("user_id FROM", "user_id, tol_s FROM").replace("SELECT user_id, 1 AS i", "SELECT user_id, tol_s, 1 AS i").replace("SELECT k.user_id,", "SELECT k.user_id, k.tol_s,").replace("SELECT a.user_id,", "SELECT a.user_id, a.tol_s,").replace("a.user_id = k.user_id", "a.user_id = k.user_id AND a.tol_s = k.tol_s").replace("b.user_id = k.user_id", "b.user_id = k.user_id AND b.tol_s = k.tol_s").replace("SELECT user_id, '", "SELECT user_id, tol_s, '").replace("tp.user_id = a.user_id", "tp.user_id = a.user_id AND tp.tol_s = a.tol_s").replace("tp.user_id = b.user_id", "tp.user_id = b.user_id AND tp.tol_s = b.tol_s")


@query("tolerance_sweep", f"{SWEEP}, {rates_sql('user_id, tol_s')} SELECT user_id, tol_s, tp, fn, fp, round(md, 3) AS median_dt_ms, round(p95, 3) AS p95_abs_dt_ms, round(sens, 6) AS sens, round(ppv, 6) AS ppv, round(f1, 6) AS f1 FROM g")
def tolerance_sweep(spark, sf_dir):
    a, b = trains(spark, sf_dir)
    x = M.tolerance_sweep(a, b, USER, "t", [HOUR, 6 * HOUR])
    return rounded(rounded(x, "sens", "ppv", "f1"), "median_dt_ms", "p95_abs_dt_ms", digits=3)


@query("segment_index", f"""WITH {E}, {TRUTH}, r AS (SELECT user_id, max(t) AS dur FROM e GROUP BY 1), w AS (SELECT user_id, i AS window_idx, i * 21600.0::DOUBLE AS a, (i + 1) * 21600.0::DOUBLE AS b FROM r, LATERAL (SELECT unnest(range(floor(dur / 21600)::BIGINT)) AS i))
SELECT user_id, window_idx, CASE WHEN EXISTS (SELECT 1 FROM truth s WHERE s.user_id = w.user_id AND a < t1 AND b > t0) THEN 'seizure_core' WHEN EXISTS (SELECT 1 FROM truth s WHERE s.user_id = w.user_id AND a < t1 + 21600 AND b > t0 - 21600) THEN 'seizure_extended' ELSE 'baseline' END AS context FROM w""")
def segments(spark, sf_dir):
    r = events_table(spark, sf_dir).groupBy("user_id").agg(F.max("t").alias("dur"))
    return segment_index(r, truth(spark, sf_dir), USER, "dur", ("t0", "t1"), 6 * HOUR, 6 * HOUR).select("user_id", "window_idx", "context")


@query("peri_windows", f"""WITH {E}, {TRUTH}, w AS (SELECT user_id, seizure_id, r.role, greatest(CASE WHEN r.role = 'ictal' THEN t0 WHEN r.role LIKE 'pre%' THEN t0 + r.o ELSE t1 + r.o END, 0) AS a, CASE WHEN r.role = 'ictal' THEN t1 WHEN r.role LIKE 'pre%' THEN t0 + r.o + 60 ELSE t1 + r.o + 60 END AS b
FROM truth, (VALUES ('pre_20min', -1200), ('pre_2min', -120), ('post_2min', 120), ('post_20min', 1200), ('ictal', 0)) r(role, o)) SELECT user_id, seizure_id, role, round(a, 6) AS w_start, round(b, 6) AS w_end FROM w WHERE b > a""")
def peri(spark, sf_dir):
    return rounded(peri_windows(truth(spark, sf_dir)).select("user_id", "seizure_id", "role", "w_start", "w_end"), "w_start", "w_end")


@query("shifted_windows", f"""WITH {E}, {TRUTH}, d AS (SELECT user_id, max(t) AS dur FROM e GROUP BY 1), w AS (SELECT user_id, seizure_id, s, greatest(t + s - 300, 0) AS a, least(t + s + 300, dur) AS b, t + s - 300 < 0 OR t + s + 300 > dur AS truncated FROM truth JOIN d USING (user_id), (VALUES (-7200.0::DOUBLE), (-3600), (0), (3600), (7200)) v(s))
SELECT user_id, seizure_id, s AS shift_s, round(a, 6) AS w_start, round(b, 6) AS w_end, truncated FROM w WHERE b > a""")
def shifted(spark, sf_dir):
    d = events_table(spark, sf_dir).groupBy("user_id").agg(F.max("t").alias("dur"))
    x = shifted_windows(truth(spark, sf_dir).join(d, "user_id"), F.col("t"), "dur")
    return rounded(x.select("user_id", "seizure_id", "shift_s", "w_start", "w_end", "truncated"), "w_start", "w_end")

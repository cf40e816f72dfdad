"""Operators whose work is dealt over tasks: blocks of time, selection, sweeps, interval trees. Each against a plain version."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatlake.operators import audit as A
from beatlake.operators import events as V
from beatlake.operators import intervals as I
from beatlake.operators import matching as M
from beatlake.operators import quality as Q
from beatlake.operators import quantiles as N
from beatlake.operators import scan
from beatlake.operators import scoring as S
from beatlake.operators import summaries as U

K = ["r"]
#: One block for all, and 50.
BLOCKS = (None, 1e6, 20.0)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(7)
    rows = [(r, float(t)) for r in range(3) for t in np.round(np.sort(rng.uniform(0, 1000, 400)), 2)]
    # ties, a long gap, and a recording of one row
    rows += [(0, 500.0), (0, 500.0), (3, 12.5)] + [(4, float(t)) for t in (0, 1, 999, 1000)]
    return frame(spark, rows, "r int, t double").cache()


def test_nearest_in_blocks(spark, series):
    b = series.where("t * 100 % 7 < 2")
    a = series.where("t * 100 % 7 >= 2").distinct()
    known = {}
    for r, t in b.collect():
        known.setdefault(r, []).append(t)
    want = []
    for r, t in a.collect():
        near = min(known.get(r, []), key=lambda x: (abs(x - t), x), default=None)
        want.append((r, t, near))
    for block in BLOCKS:
        assert rows_of(I.nearest(a, b, K, "t", "t", block=block), "r", "t", "t_near") == sorted(want, key=repr), block


def test_asof_in_blocks(spark, series):
    w = series.where("t * 100 % 5 < 1").distinct().select("r", F.col("t").alias("s"), (F.col("t") + 30).alias("e"), F.col("t").alias("name"))
    starts = {}
    for x in w.collect():
        starts.setdefault(x.r, []).append((x.s, x.e))
    want = []
    for r, t in series.distinct().collect():
        s = max((s for s in starts.get(r, []) if s[0] <= t), default=None)
        if s and t < s[1]:
            want.append((r, t, s[0]))
    for block in BLOCKS:
        assert rows_of(I.asof_window(series.distinct(), w, K, "t", "s", "e", ["name"], [], block), "r", "t", "name") == sorted(want, key=repr), block


def test_islands_merges_and_refractory_times_in_blocks(spark, series):
    by = {}
    for r, t in sorted(map(tuple, series.collect())):
        by.setdefault(r, []).append(t)
    islands, kept, merged = [], [], []
    for r, ts in by.items():
        groups, last, spans = [[ts[0]]], None, []
        for t in ts[1:]:
            groups[-1].append(t) if t - groups[-1][-1] <= 4 else groups.append([t])
        islands += [(r, g[0], g[-1], len(g)) for g in groups]
        for t in ts:
            if last is None or t - last >= 15:
                kept.append((r, t))
                last = t
        for t in ts:  # lengths vary, so early intervals can reach over blocks
            end = t + (60 if t * 100 % 11 < 1 else 1)
            if spans and t <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(end, spans[-1][1]), spans[-1][2] + 1)
            else:
                spans.append((t, end, 1))
        merged += [(r, *s) for s in spans]
    iv = series.select("r", F.col("t").alias("t_start"), (F.col("t") + F.when(F.col("t") * 100 % 11 < 1, 60).otherwise(1)).alias("t_end"))
    for block in BLOCKS:
        found = V.event_list(series.withColumn("v", F.lit(1.0)), K, [], "t", "v", 0.0, 4.0, block=block)
        assert rows_of(found, "r", "t_start", "t_end", "n_points") == sorted(islands, key=repr), block
        assert rows_of(V.refractory(series, K, "t", 15.0, block), "r", "t") == sorted(kept, key=repr), block
        assert rows_of(V.merge_overlaps(iv, K, block=block), "r", "t_start", "t_end", "n_merged") == sorted(merged, key=repr), block


@pytest.mark.parametrize("hold", [0.3, 7.0, 100.0, 5000.0])
def test_refractory_longer_and_shorter_than_blocks(spark, series, hold):
    whole = rows_of(V.refractory(series, K, "t", hold), "r", "t")
    assert rows_of(V.refractory(series, K, "t", hold, 20.0), "r", "t") == whole


def test_what_a_block_leaves_like_a_walk():
    rng = np.random.default_rng(3)
    for _ in range(200):
        times = np.unique(np.round(rng.uniform(0, 50, rng.integers(1, 40)), 1))
        hold = float(rng.choice([0.5, 3.0, 20.0, 80.0]))
        upto, leave = scan.leaving(times, hold)
        for last in (-np.inf, *(times[0] - rng.uniform(0.01, 90, 5))):
            state = last
            for t in times:
                if t - state >= hold:
                    state = t
            assert next((to for u, to in zip(upto, leave) if u - last >= hold), last) == state


def test_a_long_recording_takes_no_quadratic_time(spark):
    """A million points of one recording, few of them on the right."""
    x = spark.range(1_000_000, numPartitions=8).select(F.lit(1).alias("r"), (F.col("id") * 0.75).alias("t"))
    began = time.time()
    got = I.nearest(x, x.where("t % 3000 = 0"), K, "t", "t", block=20_000.0).agg(F.count("t_near").alias("n"), F.max(F.abs("dt")).alias("far")).first()
    assert got.n == 1_000_000 and got.far <= 3000
    assert V.refractory(x, K, "t", 60.0, 20_000.0).count() == 12_500
    assert V.event_list(x.withColumn("v", F.lit(1.0)), K, [], "t", "v", 0.0, block=20_000.0).count() == 1
    assert time.time() - began < 60
    plan = I.nearest(x, x, K, "t", "t", block=20_000.0)._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan.lower().replace(" ", "").replace("currentrow$(),unboundedfollowing$()", "")


def test_nulls_in_times_and_keys(spark):
    x = frame(spark, [(1, None), (1, 5.0), (None, 5.0), (None, 9.0)], "r int, t double")
    for block in BLOCKS:
        assert rows_of(I.nearest(x, x, K, "t", "t", block=block), "r", "t", "t_near") == sorted([(1, None, None), (1, 5.0, 5.0), (None, 5.0, 5.0), (None, 9.0, 9.0)], key=repr)
        assert V.refractory(x, K, "t", 1.0, block).count() == 3
        assert V.merge_overlaps(x.limit(0).select("r", F.col("t").alias("t_start"), F.col("t").alias("t_end")), K, block=block).count() == 0


def intervals_of(rng, n, r=3):
    """Lengths from nothing to a day, starts over a week."""
    return [(int(rng.integers(0, r)), float(a), float(a + d)) for a, d in zip(np.round(rng.uniform(0, 6e5, n)), np.round(10 ** rng.uniform(-1, 5, n) - 0.2))]


@pytest.mark.parametrize("closed", [False, True])
def test_overlaps_of_unequal_lengths_like_brute_force(spark, closed):
    rng = np.random.default_rng(11)
    a, b = intervals_of(rng, 300), intervals_of(rng, 300)
    a += [(0, -100.0, -50.0), (1, 64.0, 128.0), (1, 128.0, 128.0)]
    b += [(0, -60.0, 4e9), (1, 128.0, 256.0), (1, 0.0, 64.0), (2, 5.0, None)]
    x, y = frame(spark, a, "r int, a double, b double"), frame(spark, b, "r int, c double, d double")
    hit = (lambda p, q: p[1] <= q[2] and p[2] >= q[1]) if closed else (lambda p, q: p[1] < q[2] and p[2] > q[1])
    want = sorted(((*p, *q[1:]) for p in a for q in b if p[0] == q[0] and q[2] is not None and hit(p, q)), key=repr)
    assert rows_of(I.overlap_pairs(x, y, K, ("a", "b"), ("c", "d"), closed), "r", "a", "b", "c", "d") == want


def test_a_long_interval_is_few_rows(spark):
    w = spark.range(0, 100_000).select(F.lit(1).alias("r"), (F.col("id") * 10.0).alias("a"), (F.col("id") * 10.0 + 10).alias("b"))
    e = frame(spark, [(1, 0.0, 86400.0), (1, 0.0, 9e12)], "r int, c double, d double")
    with_level = lambda df, s, t: df.withColumn("_own", I.level(F.col(s), F.col(t)))
    long, short = with_level(e, "c", "d"), with_level(w, "a", "b")
    assert I.nodes(long, F.col("c"), F.col("d"), short).count() <= 6
    assert I.nodes(short, F.col("a"), F.col("b"), long).count() <= 6 * 100_000
    assert I.overlap_pairs(w, e, K, ("a", "b"), ("c", "d")).count() == 8640 + 100_000


def test_overlap_users_join_on_nodes(spark):
    """Neither compares all windows of a recording with all its events."""
    w = frame(spark, [(1, 0, 0.0, True), (1, 1, 60.0, False)], "r int, window_idx int, s double, ok boolean")
    e = frame(spark, [(1, 9, 70.0)], "r int, event_id int, on double")
    found = frame(spark, [(1, 65.0)], "r int, t_peak double")
    true = frame(spark, [(1, 60.0, 62.0)], "r int, t0 double, t1 double")
    out = Q.rejection_around_onset(w, e, K, "s", "on", "ok", ["event_id"], 100.0, 100.0, 60.0)
    scores = S.peak_scores(found, true, K, "t_peak", ("t0", "t1"), 5.0)
    assert rows_of(out, "bin_s", "rejection_rate") == [(-120.0, 0.0), (-60.0, 1.0)] and rows_of(scores, "r", "n_true", "n_false") == [(1, 1, 0)]
    for df in (out, scores):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "_node" in plan and "Cross" not in plan


VALUES = {
    "uniform": lambda rng, n: rng.uniform(-5, 5, n),
    "heavy": lambda rng, n: rng.standard_cauchy(n) ** 3,
    "scales": lambda rng, n: 10.0 ** rng.uniform(-300, 300, n),
    "near": lambda rng, n: 1e9 + rng.uniform(0, 1e-3, n),
    "ties": lambda rng, n: rng.integers(0, 3, n).astype(float),
    "ends": lambda rng, n: rng.choice([-np.inf, 0.0, 1.0, np.inf, np.nan], n),
}


@pytest.mark.parametrize("kind", VALUES)
def test_selection_like_percentile(spark, kind):
    rng = np.random.default_rng(5)
    x = VALUES[kind](rng, 3000)
    rows = [("a" if i % 4 else None, float(v) if i % 50 else None) for i, v in enumerate(x)] + [("none", None)]
    df = frame(spark, rows, "k string, v double")
    qs = [0.0, 0.01, 0.5, 0.9, 0.987, 1.0]
    want = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, qs))).alias("q")).collect()}
    for small in (300, 10_000):
        got = {r.k: [r[f"q{i}"] for i in range(len(qs))] for r in N.quantiles(df, ["k"], {f"q{i}": ("v", q) for i, q in enumerate(qs)}, small).collect()}
        assert got.keys() == want.keys()
        for k, q in want.items():
            assert q is None and got[k] == [None] * len(qs) or np.array_equal(np.array(q, float), np.array(got[k], float), equal_nan=True), (kind, small, k)


def test_selection_in_a_large_group(spark):
    """A million different values of one group beside small ones; no task sorts more than SMALL of them."""
    df = spark.range(1_000_000, numPartitions=8).select(F.when(F.col("id") < 999_990, "big").otherwise("small").alias("k"), (F.exp(F.col("id") / 1e5)).alias("v"))
    got = {r.k: (r.m, r.p) for r in N.quantiles(df, ["k"], {"m": ("v", 0.5), "p": (F.col("v") * 2, 0.99)}, 1000).collect()}
    v = np.exp(np.arange(1_000_000) / 1e5)
    for k, x in (("big", v[:999_990]), ("small", v[999_990:])):
        assert got[k] == pytest.approx((np.percentile(x, 50), 2 * np.percentile(x, 99)), rel=1e-9)


def test_selection_without_rows_or_keys(spark):
    df = frame(spark, [(1, 2.0), (1, 4.0)], "k int, v double")
    assert N.quantiles(df, [], {"m": ("v", 0.5)}).collect()[0].m == 3.0
    assert N.quantiles(df.limit(0), [], {"m": ("v", 0.5)}).collect()[0].m is None
    assert N.quantiles(df.limit(0), ["k"], {"m": ("v", 0.5)}).count() == 0


def trains(spark, seed=2):
    rng = np.random.default_rng(seed)
    a = {r: np.sort(np.round(rng.uniform(0, 600, 80), 3)) for r in range(3)}
    b = {r: np.sort(np.round(np.concatenate([t[::2] + 3.7 * (r - 1), rng.uniform(0, 600, 20)]), 3)) for r, t in a.items()}
    make = lambda d: frame(spark, [(r, float(t), float(t % 1)) for r, ts in d.items() for t in ts], "r int, t double, rr double")
    return a, b, make(a), make(b)


def test_offsets_like_brute_force(spark):
    a, b, x, y = trains(spark)
    for offsets, tol in (([(i - 600) * 0.02 for i in range(1201)], 0.05), ([float(i) for i in range(-10, 11)], 2.0), ([1.5], 0.5), ([0.0, 3.7, -3.7, 1.0, 3.7, 2.9], 0.9)):
        want = []
        for r in a:
            tp = [int((np.abs(a[r][:, None] - (b[r] + o)[None]) <= tol + M.SLACK).any(1).sum()) for o in offsets]
            if max(tp):
                want.append((r, round(offsets[int(np.argmax(tp))], 9), max(tp)))
        assert rows_of(M.offset_search(x.union(x), y.union(y), K, "t", offsets, tol), "r", "best_offset", "tp") == want


def test_many_offsets_cost_what_few_do(spark):
    _, _, x, y = trains(spark)
    for offsets in ([(i - 6000) * 0.02 for i in range(12_001)], [float(i * 12) for i in range(-10, 11)]):
        near = M.near_pairs(x.select("r", F.col("t").alias("_r")), y.select("r", F.col("t").alias("_t")), K, M.Grid(offsets), 0.5)
        assert near.count() <= 3 * 80 * 60  # a pair is made once


def test_deltas_like_brute_force(spark):
    a, b, x, y = trains(spark)
    deltas, tol = [(i - 40) * 0.25 for i in range(81)], 0.6
    want = []
    for r in a:
        best = None
        for d in deltas:
            hit = np.abs(a[r][:, None] - (b[r] + d)[None]) <= tol + M.SLACK
            if (n := int(hit.sum())) >= 5:
                mae = round(float((np.abs((a[r] % 1)[:, None] - (b[r] % 1)[None]) * 1000)[hit].mean()), 6)
                best = min(best or (np.inf,), (mae, d, n))
        want.append((r, best[1], best[2]))
    assert rows_of(M.rr_delta_search(x, y, K, "t", "rr", deltas, tol), "r", "best_delta", "n") == want


def test_shift_of_samples_like_brute_force(spark):
    rng = np.random.default_rng(4)
    u = rng.normal(size=200)
    p, q = {i: u[i] for i in range(150)}, {i: u[i + 7] for i in range(120)}
    want = min((round(float(np.mean([(p[i] - q[i - o]) ** 2 for i in p if i - o in q])), 9), n, o) for n, o in enumerate(range(-20, 21)))
    make = lambda d: frame(spark, [(1, i, float(v)) for i, v in d.items()], "r int, i int, x double")
    got = A.mse_offset(make(p), make(q), K, "i", "x", list(range(-20, 21))).first()
    assert (got.mse, got.offset) == (pytest.approx(want[0]), want[2]) and want[2] == 7


@pytest.mark.parametrize("higher", [True, False])
def test_cuts_like_trying_all_pairs(spark, higher):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 4, 400)
    s = np.round(np.where(y == 1, 30, np.where(y == 2, 20, 10)) * (1 if higher else -1) + rng.normal(0, 8, 400))
    rows = [(int(t) if t else None, float(v) if i % 40 else None, i) for i, (t, v) in enumerate(zip(y, s))]
    cuts = [float(c) * (1 if higher else -1) for c in range(0, 45, 5)]

    def f1(p, t):
        each = [2 * sum(a == c and b == c for a, b in zip(p, t)) / max(sum(a == c for a in p) + sum(b == c for b in t), 1) for c in (1, 2, 3)]
        return sum(each) / 3

    def classes(vs, t1, t2):
        ok = (lambda v, c: v is not None and v >= c) if higher else (lambda v, c: v is not None and v <= c)
        return [1 if ok(v, t1) else 2 if ok(v, t2) else 3 for v in vs]

    def best(part):
        pairs = [(a, b) for a in cuts for b in cuts if (a > b if higher else a < b)]
        return max(((round(f1(classes([v for _, v, _ in part], *p), [t for t, _, _ in part]), 9), -i, p) for i, p in enumerate(pairs)))

    df = frame(spark, rows, "y int, s double, i int")
    got, want = U.fit_two_cuts(df, "s", "y", cuts, higher).first(), best(rows)
    assert ((got.t1, got.t2), got.macro_f1) == (want[2], pytest.approx(want[0]))
    split = U.stratified_split(df, "y", F.col("i"), "seed", 0.75).collect()
    for c in (None, 1, 2, 3):
        part = [r for r in split if r.y == c]
        assert abs(sum(r.is_train for r in part) - 0.75 * len(part)) <= 1
    train, test = ([(r.y, r.s, r.i) for r in split if r.is_train == k] for k in (True, False))
    out, want = U.fit_and_test(df, "s", "y", F.col("i"), cuts, "seed", 0.75, higher).first(), best(train)
    assert (out.t1, out.t2, out.n_test) == (*want[2], len(test)) and out.train_macro_f1 == pytest.approx(want[0])
    assert out.test_macro_f1 == pytest.approx(f1(classes([v for _, v, _ in test], out.t1, out.t2), [t for t, _, _ in test]))

import numpy as np
import pytest

from beatlake.operators import events as V
from beatlake.operators import intervals as I
from beatlake.operators import matching as M

K = ["r"]


def times(spark, values, value=1.0):
    return spark.createDataFrame([(1, float(t), value) for t in values], "r int, t double, v double")


def walk(a, b, tol):
    """Two pointers over sorted times: the earliest pair within the tolerance matches, the earlier of a pair beyond it is passed."""
    i = j = 0
    left, right = [], []
    while i < len(a) and j < len(b):
        if abs(b[j] - a[i]) <= tol + M.SLACK:
            left.append(i)
            right.append(j)
            i, j = i + 1, j + 1
        elif b[j] > a[i]:
            i += 1
        else:
            j += 1
    return left, right


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_islands_split_only_beyond_the_gap(spark):
    got = V.event_list(times(spark, [0, 10, 70, 131]), K, [], "t", "v", 0.5, 60.0)
    assert pairs(got, "t_start", "t_end", "n_points") == [(0, 70, 3), (131, 131, 1)]


def test_peak_is_the_first_of_equals(spark):
    x = spark.createDataFrame([(1, 1.0, 5.0), (1, 2.0, 7.0), (1, 3.0, 7.0)], "r int, t double, v double")
    assert V.event_list(x, K, [], "t", "v", 0.0).first()["t_peak"] == 2.0


def test_refractory(spark):
    assert pairs(V.refractory(times(spark, [0, 30, 60, 100, 130]), K, "t", 60.0), "t") == [(0,), (60,), (130,)]


def test_merge_overlaps(spark):
    x = spark.createDataFrame([(1, 0.0, 5.0), (1, 1.0, 2.0), (1, 5.0, 6.0), (1, 7.0, 8.0)], "r int, t_start double, t_end double")
    assert pairs(V.merge_overlaps(x, K), "t_start", "t_end", "n_merged") == [(0, 6, 3), (7, 8, 1)]


def test_trim_points(spark):
    bad = [True, False, False, False, True, False, True]
    x = spark.createDataFrame([(1, i, b) for i, b in enumerate(bad)], "r int, idx int, bad boolean")
    r = V.trim_points(x, K, "idx", x.bad, 3, 3).first()
    assert (r["trim_first"], r["trim_last"]) == (1, 3)


def test_overlap_strict_and_closed(spark):
    w = spark.createDataFrame([(1, 0, 10.0, 20.0)], "r int, window_idx int, a double, b double")
    e = spark.createDataFrame([(1, 20.0, 30.0)], "r int, t0 double, t1 double")
    flag = lambda closed: I.overlap_flag(w, e, K, ["window_idx"], ("a", "b"), ("t0", "t1"), closed).first()["overlaps_event"]
    assert not flag(False) and flag(True)


def test_overlap_pairs_like_brute_force(spark):
    rng = np.random.default_rng(1)
    w, e = ([(int(rng.integers(0, 3)), float(a), float(a + d)) for a, d in zip(rng.uniform(0, 100, 60), rng.exponential(9, 60))] for _ in range(2))
    a, b = spark.createDataFrame(w, "r int, a double, b double"), spark.createDataFrame(e, "r int, c double, d double")
    want = sorted((x[1], y[1]) for x in w for y in e if x[0] == y[0] and x[1] < y[2] and x[2] > y[1])
    assert pairs(I.overlap_pairs(a, b, K, ("a", "b"), ("c", "d")), "a", "c") == want


def test_asof_with_validity(spark):
    w = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 10.0, 20.0), (1, 2, 30.0, 40.0)], "r int, idx int, s double, e double")
    got = I.asof_window(times(spark, [5, 10, 25, -1]), w, K, "t", "s", "e", ["idx"], ["v"])
    assert pairs(got, "t", "idx") == [(5, 0), (10, 1)]


def test_nearest_prefers_the_earlier(spark):
    got = I.nearest(times(spark, [5, 100]), times(spark, [4, 6]), K, "t", "t", 2.0)
    assert pairs(got.na.fill(-1.0), "t", "t_near") == [(5, 4), (100, -1)]


def test_greedy_match_by_hand(spark):
    got = M.metrics(M.greedy_match(times(spark, [1, 2, 3]), times(spark, [1.03, 2.5, 3]), K, "t", 0.04), K).first()
    assert (got["tp"], got["fn"], got["fp"]) == (2, 1, 1)
    assert got["sens"] == got["ppv"] == got["f1"] == pytest.approx(2 / 3)


def test_empty_train_gives_only_misses(spark):
    got = M.metrics(M.greedy_match(times(spark, [1, 2]), times(spark, [1]).limit(0), K, "t", 0.1), K).first()
    assert (got["tp"], got["fn"], got["fp"], got["ppv"]) == (0, 2, 0, None)


def test_band_match_equals_greedy_for_sparse_trains(spark):
    rng = np.random.default_rng(5)
    a = np.cumsum(rng.uniform(0.5, 1.0, 80))
    b = a[rng.random(80) > 0.2] + 0.01
    x, y = times(spark, a), times(spark, b)
    tp = M.greedy_match(x, y, K, "t", 0.1).where("kind = 'TP'")
    assert pairs(M.band_match(x, y, K, "t", 0.1), "t_ref", "t_test") == pairs(tp, "t_ref", "t_test")


def test_offset_search_finds_the_shift(spark):
    a = np.cumsum(np.random.default_rng(2).uniform(0.6, 1.1, 50))
    got = M.offset_search(times(spark, a), times(spark, a - 1.5), K, "t", [-1.5, 0.0, 0.5, 1.0, 1.5, 2.0], 0.04).first()
    assert got["best_offset"] == 1.5 and got["tp"] == 50


def test_rr_agreement_by_hand(spark):
    x = spark.createDataFrame([(1, 1.0, 1.0)] * 3 + [(1, 2.0, 1.0)], "r int, a double, b double")
    r = M.rr_agreement(x, K, "a", "b").first()
    assert (r["rr_mae_ms"], r["rr_rmse_ms"], r["mean_hr_ref"], r["mean_hr_test"], r["mean_hr_diff"]) == (250, 500, 48, 60, 12)


def test_long_trains_are_cut_at_gaps_alone(spark):
    import numpy as np

    r = np.random.default_rng(0)
    a, b = np.sort(r.random(3000) * 3000), np.sort(r.random(3000) * 3000)
    x, y = times(spark, a.tolist()), times(spark, b.tolist())
    left, right = walk(a, b, 0.3)
    for block in (None, 7.0, 50.0):
        tp = M.greedy_match(x, y, K, "t", 0.3, block=block).where("kind = 'TP'").collect()
        assert sorted((v["t_ref"], v["t_test"]) for v in tp) == list(zip(a[left].tolist(), b[right].tolist()))
    swept = {v["tol_s"]: v["tp"] for v in M.tolerance_sweep(x, y, K, "t", [0.1, 0.3]).collect()}
    assert swept == {0.1: len(walk(a, b, 0.1)[0]), 0.3: len(left)}


def test_refractory_and_prominence_of_long_series(spark):
    import time

    import numpy as np

    from beatlake.functions import kernels

    began = time.time()
    t = [0.5 * i for i in range(100_000)]
    assert V.refractory(times(spark, t), K, "t", 5.0).count() == 10_000
    x = np.random.default_rng(1).normal(size=200_000)
    assert len(kernels.prominent_peaks(x, 5, 2.0)) > 1000 and time.time() - began < 60

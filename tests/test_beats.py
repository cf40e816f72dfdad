import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from beatlake.operators import beats as B

K = ["r"]


def rows(spark, values, name="rr"):
    return spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], f"r int, i int, {name} double")


def column(df, c):
    return [r[c] for r in df.orderBy("i").collect()]


def test_intervals_from_peaks(spark):
    x = spark.createDataFrame([(1, p, p / 256) for p in (0, 256, 512, 1024)], "r int, i int, t double")
    got = B.rr_from_peaks(x, K, ["t"]).orderBy("t").collect()
    assert [(r["rr"], r["t"]) for r in got] == [(1.0, 1.0), (1.0, 2.0), (2.0, 4.0)]


@pytest.mark.parametrize(
    ("values", "mode", "want"),
    [
        ([1, 2, 3, 4, 5, 6, 7], "edge", [1, 2, 3, 4, 5, 6, 7]),
        ([1, 1, 1, 9, 1, 1, 1], "edge", [1] * 7),
        ([5, 1, 9], "edge", [5, 1, 9]),
        ([5, 1, 9], "trailing", [5, 3, 5]),
    ],
)
def test_median_beats(spark, values, mode, want):
    assert column(B.median_beats(rows(spark, values), K, ["i"], mode=mode), "rr_med") == want


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(300, 2000), min_size=1, max_size=25))
def test_median_edge_always_like_numpy(spark, values):
    x = np.array(values, float)
    padded = np.pad(x, 3, mode="edge")
    want = [float(np.median(padded[i : i + 7])) for i in range(len(x))]
    assert column(B.median_beats(rows(spark, values), K, ["i"], mode="edge_always"), "rr_med") == want


def test_poincare_by_hand(spark):
    x = B.poincare(rows(spark, [1000, 1010, 1000, 1010], "rr_ms"), K, ["i"], n=4).where("sd1 is not null").first()
    assert x["sd1"] == pytest.approx(8.164966, abs=1e-6) and x["sd2"] == 0
    y = B.poincare(rows(spark, [800, 810, 820, 830], "rr_ms"), K, ["i"], n=4).where("sd1 is not null")
    y = y.select("sd1", "sd2", B.csi(F.col("sd1"), F.col("sd2")).alias("csi")).first()
    assert y["sd1"] == 0 and y["sd2"] == pytest.approx(14.142136, abs=1e-6) and y["csi"] == pytest.approx(y["sd2"] / 1e-12)


def test_features_like_numpy(spark):
    rr = np.random.default_rng(3).uniform(0.5, 1.2, 60)
    n = 20
    got = B.seizure_features(rows(spark, rr), K, ["i"], n=n).orderBy("i").collect()
    filtered = np.array([np.median(np.pad(rr, 3, mode="edge")[i : i + 7]) for i in range(len(rr))])
    assert len(got) == len(rr) - n + 1
    for r, end in zip(got, range(n, len(rr) + 1)):
        w, f = rr[end - n : end] * 1000, filtered[end - n : end]
        sd = lambda v: (np.std(np.diff(v), ddof=1) / 2**0.5, np.std(v[1:] + v[:-1], ddof=1) / 2**0.5)
        a, b = sd(w), sd(f * 1000)
        slope = abs(np.polyfit(np.cumsum(f), 60 / f, 1)[0])
        assert r["CSI"] == pytest.approx(a[1] / a[0]) and r["ModCSI_filt"] == pytest.approx(4 * b[1] ** 2 / b[0]) and r["SlopeHR_abs"] == pytest.approx(slope)
        assert r["t_s"] == pytest.approx(rr[:end].sum())


def test_unit_by_median_and_row_order(spark):
    x = rows(spark, [812, 800, 830])
    assert column(B.normalised_rr(x, K), "rr") == pytest.approx([0.812, 0.8, 0.83])
    shuffled = B.median_beats(x.orderBy(F.desc("i")), K, ["i"], mode="trailing")
    assert column(shuffled, "rr_med") == column(B.median_beats(x, K, ["i"], mode="trailing"), "rr_med")


def test_irregularity_and_hrv(spark):
    x = rows(spark, [800] * 30 + [1600] + [800] * 30)
    assert B.rr_irregularity(x, K, ["i"]).first()["irregular"] == pytest.approx(1 / 61)
    h = B.hrv_summary(rows(spark, [800, 900, 800]), K, ["i"], "rr").first()
    assert h["rmssd"] == 100 and h["pnn50"] == 1 and h["n_rr"] == 3

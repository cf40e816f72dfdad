import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatlake.functions import kernels as N
from beatlake.functions import scalars as C
from beatlake.operators import matching
from beatlake.operators import quality as Q
from beatlake.operators import scoring as S
from beatlake.operators import segments as G
from beatlake.operators import signal as X
from beatlake.operators import thresholds as T
from beatlake.plans import registry, studies
from beatlake.schema import assert_unique, require_columns
from beatlake.sources import binary, sinks, text
from beatlake.streaming import detect as D


def test_file_names(spark):
    names = spark.createDataFrame([("x/P08a_R01_neurokit_rr_aligned.csv",), ("notes.csv",)], "n string")
    got = [r["p"] for r in names.select(C.parse_rr_file(F.col("n")).alias("p")).collect()]
    assert tuple(got[0]) == (8, "a", 1, "neurokit") and got[1] is None


def test_guards(spark):
    x = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(KeyError):
        require_columns(x, "k", "z")
    with pytest.raises(Exception, match="duplicate key"):
        assert_unique(x, "k").collect()
    assert assert_unique(x, "k", "v").count() == 2


def test_segment_labels(spark):
    r = spark.createDataFrame([(1, 300.0)], "r int, dur double")
    e = spark.createDataFrame([(1, 130.0, 150.0)], "r int, t0 double, t1 double")
    got = [x["context"] for x in G.segment_index(r, e, ["r"], "dur", ("t0", "t1")).orderBy("window_idx").collect()]
    assert got == ["baseline", "seizure_extended", "seizure_core", "seizure_extended", "baseline"]


def test_scores_by_hand(spark):
    found = spark.createDataFrame([(1, 690.0, 699.0), (1, 700.0, 710.0), (1, 5000.0, 5010.0)], "rec int, a double, b double")
    true = spark.createDataFrame([(1, 1000.0, 1060.0)], "rec int, t0 double, t1 double")
    hours = spark.createDataFrame([(2.0,)], "hours double")
    r = S.score(found, true, "rec", ("a", "b"), ("t0", "t1"), 300.0, hours).first()
    assert (r["n_detected"], r["n_true"], r["n_false"], r["far_per_h"], r["recall"]) == (1, 1, 2, 1.0, 1.0)


def test_auto_threshold_by_hand(spark):
    x = spark.createDataFrame([(1, 1, 10.0, 100.0), (1, 1, 90000.0, 500.0)], "p int, rec int, t double, v double")
    e = spark.createDataFrame([(1, 88000.0, 88100.0)], "rec int, t0 double, t1 double")
    r = T.segment_thresholds(x, e, "p", "rec", "t", "v", ("t0", "t1"), {"first_24h": 86400.0, "first_half": None}).first()
    assert r["threshold"] == pytest.approx(105) and r["mode"] == "first_24h"


def test_majority_and_missing_window(spark):
    x = spark.createDataFrame([(1, 0, y) for y in (0, 2, 2, 1, 1)], "r int, w int, y int")
    assert Q.window_label(x, ["r"], "w", "y").first()["y"] == 1
    p = spark.createDataFrame([(1, None), (2, False), (3, True)], "i int, ok boolean")
    got = S.with_sqi_modes(p, "ok", {"off": None, "on": "ok"})
    assert sorted((r["sqi"], r["i"]) for r in got.collect()) == [("off", 1), ("off", 2), ("off", 3), ("on", 1), ("on", 3)]


def test_window_stats_drop_the_tail(spark):
    x = spark.createDataFrame([(1, i, float(i % 4)) for i in range(10)], "r int, i int, x double")
    got = Q.window_stats(x, ["r"], "i", "x", 4).orderBy("window_idx").collect()
    assert [(r["n"], r["range"], r["diff_abs_med"]) for r in got] == [(4, 3.0, 1.0)] * 2


def test_filters_pass_and_stop():
    fs, t = 256.0, np.arange(2560) / 256.0
    slow, fast = np.sin(2 * np.pi * 2 * t), np.sin(2 * np.pi * 60 * t)
    low = N.zero_phase(slow + fast, N.butter_sections(4, (20.0,), fs, "low"))
    assert np.abs(low - slow)[200:-200].max() < 1e-2
    band = N.zero_phase(slow + fast + 3, N.butter_sections(2, (40.0, 80.0), fs, "band"))
    assert np.abs(band - fast)[300:-300].max() < 5e-2
    assert np.abs(N.zero_phase(fast, N.notch_section(60.0, fs, 5.0)))[600:-600].max() < 1e-2
    high = N.zero_phase(slow + 5, N.butter_sections(2, (0.5,), fs, "high"))
    assert np.abs(high - slow)[400:-400].max() < 0.1


def test_welch_power_and_wavelets():
    fs, x = 128.0, np.random.default_rng(0).normal(0, 1, 12800)
    f, p = N.welch(x, fs, 256)
    assert np.trapezoid(p, f) == pytest.approx(x.var(), rel=0.05)
    parts = N.dwt_levels(x[:1024], 3)
    assert sum((d**2).sum() for d in parts) == pytest.approx((x[:1024] ** 2).sum(), rel=0.1)
    assert N.cross_lag(x[:500], np.concatenate([np.zeros(7), x[:493]])) == 7


def test_chunked_filter_equals_whole(spark):
    x = np.random.default_rng(1).normal(0, 1, 4000)
    chunks = spark.createDataFrame([(1, i, x[i * 1000 : i * 1000 + 1000].tolist()) for i in range(4)], "r int, chunk_idx int, samples array<double>")
    sos = N.butter_sections(2, (20.0,), 128.0, "low")
    got = np.concatenate([r["samples"] for r in X.filter_chunks(chunks, ["r"], sos, 400).orderBy("chunk_idx").collect()])
    assert np.abs(got - N.zero_phase(x, sos)).max() < 1e-6


def test_detection_from_signal(spark):
    fs, beats = 128.0, np.cumsum(np.random.default_rng(4).uniform(0.7, 1.0, 150))
    t = np.arange(int(beats[-1] * fs) + 64) / fs
    ecg = sum(np.exp(-0.5 * ((t - b) / 0.015) ** 2) for b in beats)
    df = spark.createDataFrame([(1, ecg.tolist())], "r int, samples array<double>")
    got = studies.signal_study(df, ["r"], fs, n_beats=20)
    peaks = np.array(sorted(r["t"] for r in got["peaks"].collect()))
    hit = [np.abs(peaks - b).min() < 0.03 for b in beats[1:-1]]
    assert np.mean(hit) > 0.97 and got["features"].count() > 100


def test_detectors():
    fs, rng = 256.0, np.random.default_rng(7)
    beats = np.cumsum(0.8 + 0.05 * rng.standard_normal(140))
    t = np.arange(int(beats[-1] * fs) + 128) / fs
    heights = np.where(np.isin(np.arange(len(beats)), (20, 50, 51)), 0.5, 1.0)
    ecg = 0.03 * rng.standard_normal(len(t)) + sum(h * np.exp(-(((t - b) / 0.012) ** 2)) + 0.2 * np.exp(-(((t - b - 0.3) / 0.05) ** 2)) for b, h in zip(beats, heights))
    share = lambda p: np.mean([np.abs(p / fs - b).min() < 0.04 for b in beats])
    whole, high = N.two_level_peaks(ecg, fs), N.two_level_peaks(ecg, fs, look_back=False)
    assert share(whole) == 1 and abs(len(whole) - len(beats)) <= 2
    # without the low level the three small beats are missed
    assert len(high) == len(beats) - 3 and np.diff(whole).min() >= 0.25 * fs
    assert np.abs(N.two_level_peaks(-ecg, fs)[:, None] - whole).min(1).max() <= 1
    # the energy's maximum may lie anywhere in its 150 ms window around a beat
    simple = N.energy_peaks(ecg, fs)
    assert np.mean([np.abs(simple / fs - b).min() < 0.1 for b in beats]) > 0.95 and abs(len(simple) - len(beats)) <= 3
    assert N.wave_ratio(ecg, fs) > 2 and np.isnan(N.wave_ratio(ecg[:100], fs))
    for x in (np.zeros(100), np.ones(4)):
        assert not len(N.two_level_peaks(x, fs)) and not len(N.energy_peaks(x, fs))


def test_high_level_by_hand():
    # windows of two samples: 0.75 of the first maximum, then of the median of those before
    x = np.array([1.0, 4.0, 2.0, -9.0, 8.0, 0.0])
    assert N.rising_levels(x, 1.0).tolist() == [3.0, 3.0, 3.0, 3.0, 2.25, 2.25]


@pytest.mark.parametrize("n", [7, 64, 101, 1000])
def test_wavelet_bands_add_up(n):
    x = np.random.default_rng(n).normal(0, 1, n)
    assert np.abs(sum(N.dwt_band(x, j, 4) for j in range(5)) - x).max() < 1e-9


def test_small_operators(spark):
    m = spark.createDataFrame([("a", 1, 1, 0), ("a", 3, 0, 0), ("b", 0, 0, 0), ("c", 1, 0, 0)], "variant string, tp int, fn int, fp int")
    got = matching.ranked(matching.pooled(m, ["variant"]), ["variant"]).orderBy("rank").collect()
    assert [(r["variant"], r["tp"], r["f1"] and round(r["f1"], 4)) for r in got] == [("c", 1, 1.0), ("a", 4, 0.8889), ("b", 0, None)]
    x = spark.createDataFrame([(list(range(10)),), ([],), ([1],)], "s array<int>")
    assert [r[0] for r in x.select(G.trim_samples(F.col("s"), 1.0, 1.5, 1.5)).collect()] == [[2, 3, 4, 5, 6, 7], [], []]
    assert x.select(G.trim_samples(F.col("s"), 1.0, 1.5, 1.5, "cut")).first()[0] == [1, 2, 3, 4, 5, 6, 7, 8]
    rows = spark.createDataFrame([("p", 1, ["log", None]), ("p", 2, ["Start tid", "Slut tid"]), ("p", 3, ["9:00", None]), ("q", 11, ["start", "slut"]), ("q", 12, ["1", "2"])], "path string, line int, cells array<string>")
    assert [tuple(r) for r in text.below_header(rows, ("start",), ("slut", "end")).collect()] == [("p", 3, "Start tid", "9:00")]


def write_tdms(x, fs, start_us):
    text_ = lambda s: struct.pack("<I", len(s)) + s.encode()
    stamp = struct.pack("<Qq", 0, start_us // 1_000_000 + binary.EPOCH_1904_S)
    props = [text_("wf_increment") + struct.pack("<Id", 10, 1 / fs), text_("wf_start_time") + struct.pack("<I", 0x44) + stamp]
    obj = text_("/'g'/'EKG 1'") + struct.pack("<IIIQ", 20, 10, 1, len(x)) + struct.pack("<I", 2) + b"".join(props)
    meta, raw = struct.pack("<I", 1) + obj, np.asarray(x, "<f8").tobytes()
    return b"TDSm" + struct.pack("<IIQQ", 0b1110, 4713, len(meta) + len(raw), len(meta)) + meta + raw


def test_binary_sources(spark, tmp_path):
    x = np.arange(10.0)
    (tmp_path / "a.tdms").write_bytes(write_tdms(x, 256.0, 1_700_000_000_000_000))
    r = binary.read_tdms(spark, str(tmp_path)).first()
    assert r["fs"] == 256 and r["start_us"] == 1_700_000_000_000_000 and r["samples"] == x.tolist() and r["channel"] == "EKG 1"
    (tmp_path / "rec.hea").write_text("rec 1 1000 4\nrec.dat 16 100(5) 16 0 0 0 0 ECG\n")
    (tmp_path / "rec.dat").write_bytes(np.array([5, 105, 205, 305], "<i2").tobytes())
    assert binary.read_wfdb(spark, str(tmp_path)).first()["samples"] == [0, 1, 2, 3]


def test_text_sources(spark, tmp_path):
    head = ["Date\t2023/05/04", "Time\t10:20:30,1234567"] + ["x"] * 20
    (tmp_path / "p.lvm").write_text("\n".join(head + ["0\t812,5", "1\t800,0", "2\t830,0"]))
    path = str(tmp_path / "p.lvm")
    assert [r["rr"] for r in text.read_lvm_rr(spark, path).orderBy("ord").collect()] == pytest.approx([0.8125, 0.8, 0.83])
    assert str(text.read_lvm_start(spark, path).first()["start"]) == "2023-05-04 10:20:30.123457"
    pairs = tmp_path / "rr"
    pairs.mkdir()
    (pairs / "P08a_R01_neurokit_rr_aligned.csv").write_text("RR_labview_s,RR_python_s\n0.8,0.81\n0.9,0.91\n")
    got = text.read_rr_pairs(spark, str(pairs)).orderBy("ord").collect()
    assert [(r["patient_id"], r["ord"], r["rr_python_s"]) for r in got] == [(8, 1, 0.81), (8, 2, 0.91)]
    (tmp_path / "ann.csv").write_text(",".join(["0"] * 9 + ["1", "5", "2"]) + "\n" + ",".join(["0"] * 9 + ["3", "9", "1"]) + "\n")
    iv = text.read_consensus_csv(spark, str(tmp_path / "ann.csv"))
    pts = iv.select("path").distinct().withColumn("t", F.explode(F.array(*(F.lit(i) for i in range(10)))))
    assert [r["class"] for r in text.class_at(iv, pts, "t").orderBy("t").collect()] == [0, 2, 2, 1, 1, 1, 1, 1, 1, 0]
    files = text.manifest(spark, str(tmp_path))
    assert {r["extension"]: r["n"] for r in files.groupBy("extension").agg(F.count("*").alias("n")).collect()} == {"lvm": 1, "csv": 2}


def test_annotations_seconds_or_times(spark):
    x = spark.createDataFrame([("a", "10,5", None), ("a", "20", "25"), ("b", "04-05-2023 10:00:00", None)], "path string, Start string, End string")
    got = {(r["path"], r["start_s"]): r for r in text.normalise_annotations(x).collect()}
    assert got["a", 10.5]["end_s"] == 40.5 and got["a", 20.0]["end_s"] == 25.0 and str(got["b", None]["end_ts"]) == "2023-05-04 10:00:30"


def test_cache_and_sinks(spark, tmp_path):
    want = spark.createDataFrame([(1, "m", 256.0, 0.0, 1.0), (2, "m", 256.0, 0.0, 1.0)], "recording_uid bigint, algo_id string, fs double, crop_start_s double, crop_end_s double")
    cache = str(tmp_path / "peaks")
    assert sinks.missing_from_cache(spark, want, cache).count() == 2
    sinks.append_to_cache(want.where("recording_uid = 1").withColumn("t", F.lit(0.5)), cache)
    assert [r["recording_uid"] for r in sinks.missing_from_cache(spark, want, cache).collect()] == [2]
    assert "recording\\_uid" in sinks.to_latex(want)


def test_detection_study(spark):
    rng = np.random.default_rng(0)
    rr = rng.uniform(0.7, 0.9, 400)
    rr[300:330] = np.linspace(0.9, 0.35, 30)
    pairs = spark.createDataFrame([(1, None, 1, "nk", i, float(v), float(v)) for i, v in enumerate(rr)], "patient_id bigint, enrollment_id string, recording_id bigint, algo_id string, ord int, rr_labview_s double, rr_python_s double")
    recs = spark.createDataFrame([(7, 1, None, 1)], "recording_uid bigint, patient_id bigint, enrollment_id string, recording_id bigint")
    wins = spark.createDataFrame([(7, i, i * 10.0, i * 10.0 + 10.0, True) for i in range(40)], "recording_uid bigint, window_idx bigint, win_start_s double, win_end_s double, is_acceptable boolean")
    true = spark.createDataFrame([(7, 240.0, 265.0)], "recording_uid bigint, t0 double, t1 double")
    out = studies.detection_study(pairs, recs, wins, true, studies.DetectionConfig(n_beats=30, pad_s=30.0))
    for r in out["scores"].collect():
        assert r["n_detected"] == 1 and r["recall"] == 1.0
    assert {r["is_responder"] for r in out["responder_scores"].collect()} == {"false", "all"}
    assert studies.retention_study(wins, true)["by_recording"].first()["n_all"] == 40


def test_compare_peaks(spark):
    t = np.cumsum(np.random.default_rng(1).uniform(0.6, 1.0, 60))
    a, b = (spark.createDataFrame([(1, float(v)) for v in x], "r int, t double") for x in (t, t + 0.2))
    m = studies.compare_peaks(a, b, ["r"])["metrics"].first()
    assert m["f1"] > 0.97


def test_streams_equal_batch(spark, tmp_path):
    rows = [(u, float(t), float(v)) for u in (1, 2) for t, v in zip(range(0, 1000, 10), np.random.default_rng(u).uniform(0, 10, 100))]
    df = spark.createDataFrame(rows, "user_id bigint, t double, value double")
    df.repartition(1).sortWithinPartitions("t").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = D.run_to_table(D.refractory_alarms(stream, "user_id", "t", "value", 8.0, 60.0), "alarms")
    from beatlake.operators.events import refractory

    want = refractory(df.where("value > 8"), ["user_id"], "t", 60.0)
    assert sorted((r["user_id"], r["t"]) for r in got.collect()) == sorted((r["user_id"], r["t"]) for r in want.collect())
    feats = D.run_to_table(D.beat_features(stream, "user_id", "t", 10), "beats")
    assert feats.count() == 2 * 90


def test_queries_have_names_and_run(spark):
    q, o = registry.queries(), registry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 120
    assert registry.flagship(spark, "/root/testdata/sf0.001").count() > 0

"""Sources and sinks dealt over tasks: splits of text files, numbering, caches that are safe to write again, best rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatlake.operators import audit as A
from beatlake.operators import beats as B
from beatlake.operators import intervals as I
from beatlake.operators import ranges as R
from beatlake.operators import scan
from beatlake.operators import signal as X
from beatlake.operators import summaries as U
from beatlake.sources import sinks, text

K = ["r"]


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_line_numbers_over_splits(spark, tmp_path, small_splits):
    rng = np.random.default_rng(0)
    files = {f"f{i}.txt": ["" if rng.random() < 0.1 else "x" * int(rng.integers(0, 90)) + str(j) for j in range(n)] for i, n in enumerate((1, 2000, 700, 3))}
    for i, (name, lines) in enumerate(files.items()):
        (tmp_path / name).write_bytes(("\r\n" if i % 2 else "\n").join(lines).encode() + b"\n")
    got = text.numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    rows = {}
    for path, line, value in got.collect():
        rows.setdefault(path.rsplit("/", 1)[1], {})[line] = value
    assert rows == {name: dict(enumerate(lines, 1)) for name, lines in files.items()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "wholetext" not in plan.lower()


def test_interval_files_over_splits(spark, tmp_path, monkeypatch, small_splits):
    monkeypatch.setattr(text, "LINES", 300)
    rng = np.random.default_rng(1)
    values = [round(float(v), 1) for v in rng.uniform(700, 900, 3000)]
    body = [f"{i}\t{str(v).replace('.', ',')}" if i % 50 else "bad\tline" for i, v in enumerate(values)]
    (tmp_path / "a.lvm").write_text("\n".join(["head"] * 22 + body))
    got = [tuple(r) for r in text.read_lvm_rr(spark, str(tmp_path / "a.lvm")).select("ord", "rr").orderBy("ord").collect()]
    want = [v / 1000 for i, v in enumerate(values) if i % 50]
    assert [o for o, _ in got] == list(range(1, len(want) + 1)) and np.allclose([v for _, v in got], want)
    parts = [values[:1000], values[1000:1900], []]
    (tmp_path / "b.lvm").write_text("\n".join(x for p in parts for x in ["***End_of_Header***", *(f"0\t{v}" for v in p), "note"]))
    rows = text.read_lvm_segments(spark, str(tmp_path / "b.lvm")).orderBy("segment", "ord").collect()
    assert [(r.segment, r.ord) for r in rows] == [(s + 1, i + 1) for s, p in enumerate(parts) for i in range(len(p))]
    assert np.allclose([r.t for r in rows], np.concatenate([np.cumsum(p) for p in parts]))


def test_numbering_without_one_task(spark):
    rng = np.random.default_rng(2)
    rows = [(int(a), str(b)) for a, b in zip(rng.integers(0, 50, 3000), rng.permutation(3000))]
    df = spark.createDataFrame(rows, "a int, b string").repartition(7)
    got = [tuple(r) for r in scan.numbered(df, ["a", "b"], "n").orderBy("n").collect()]
    assert got == [(*r, i) for i, r in enumerate(sorted(rows))]
    assert scan.numbered(df.limit(0), ["a"], "n").count() == 0


def test_recordings_are_numbered_in_order(spark):
    files = spark.createDataFrame([("d/Patient 10b_2.tdms",), ("d/Patient 2_1.tdms",), ("d/Patient 10_1.tdms",), ("d/readme.txt",)], "path string")
    got = text.recording_index(files).orderBy("recording_uid").collect()
    order = sorted(((r.patient_id, r.enrollment_id or "", r.recording_id, r.path) for r in got))
    assert [(r.patient_id, r.enrollment_id or "", r.recording_id, r.path) for r in got] == order and [r.recording_uid for r in got] == list(range(len(got)))


KEYS = "recording_uid bigint, algo_id string, fs double, crop_start_s double, crop_end_s double"


def test_cache_written_twice_and_after_a_failed_job(spark, tmp_path):
    cache = str(tmp_path / "peaks")
    want = spark.createDataFrame([(i, "m", 256.0, 0.0, None if i == 3 else 1.0) for i in range(4)], KEYS)
    peaks = want.where("recording_uid <> 2").withColumn("t", F.explode(F.array(F.lit(0.5), F.lit(1.5))))
    first = want.where("recording_uid < 2")
    for _ in range(2):  # a repeated job
        sinks.append_to_cache(peaks.where("recording_uid < 2"), cache, first)
    assert sinks.read_cache(spark, cache).count() == 4
    # a job that fails half-way leaves what was there
    broken = peaks.withColumn("t", F.when(F.col("recording_uid") == 3, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("t")))
    with pytest.raises(Exception, match="lost"):
        sinks.append_to_cache(broken, cache, want)
    assert sinks.read_cache(spark, cache).count() == 4
    todo = sinks.missing_from_cache(spark, want, cache)
    assert sorted(r.recording_uid for r in todo.collect()) == [2, 3]
    sinks.append_to_cache(peaks.where("recording_uid >= 2"), cache, todo)
    # a recording without a peak is done as well, and has no rows
    assert sinks.missing_from_cache(spark, want, cache).count() == 0
    assert sorted(r.recording_uid for r in sinks.read_cache(spark, cache).collect()) == [0, 0, 1, 1, 3, 3]
    one = sinks.read_cache(spark, cache, want.where("recording_uid = 1"))
    assert one.count() == 2 and "PartitionFilters: [isnotnull(cache_key" in one._jdf.queryExecution().executedPlan().toString()


def test_a_cache_that_was_never_committed(spark, tmp_path):
    (tmp_path / "peaks").mkdir()
    want = spark.createDataFrame([(1, "m", 256.0, 0.0, 1.0)], KEYS)
    assert sinks.missing_from_cache(spark, want, str(tmp_path / "peaks")).count() == 1


@pytest.mark.parametrize("n", [3, 1500])
def test_best_rows_are_cut_before_they_meet(spark, n):
    df = spark.range(20_000).select((F.col("id") % 3 == 0).alias("g"), F.col("id"), F.xxhash64("id").alias("v"))
    got = U.top_n(df, ["g"], [F.desc("v"), "id"], n)
    rows = sorted(((r.g, r.v, r.id) for r in df.collect()), key=lambda r: (r[0], -r[1], r[2]))
    want = [(g, v, i) for flag in (False, True) for g, v, i in [r for r in rows if r[0] == flag][:n]]
    assert [(r.g, r.v, r.id) for r in got.orderBy("g", "rank").collect()] == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan if n < U.PUSHED else plan.count("Window [row_number") == 2


def test_outliers_by_power(spark):
    f = [float(i) for i in range(0, 100, 5)]
    rows = [(i, i % 2, f, [float(i + 1) if 45 <= x <= 55 else 100.0 for x in f]) for i in range(9)]
    df = spark.createDataFrame(rows, "k int, g int, f array<double>, p array<double>")
    assert [(r.k, r.power, r["rank"]) for r in X.power_outliers(df, ["k"], k=3).orderBy("rank").collect()] == [(8, 90.0, 1), (7, 80.0, 2), (6, 70.0, 3)]
    assert [(r.g, r.k) for r in X.power_outliers(df, ["k"], k=1, by=["g"]).orderBy("g").collect()] == [(0, 8), (1, 7)]


# Sums over ranges of time

BLOCKS = (None, 1e6, 30.0)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(5)
    rows = [(r, i, float(t), float(v)) for r in range(3) for i, (t, v) in enumerate(zip(np.sort(np.round(rng.uniform(0, 600, 150), 1)), np.round(rng.uniform(600, 1000, 150), 2)))]
    return spark.createDataFrame([*rows, (9, 0, 5.0, 800.0)], "r int, i int, t double, v double").cache(), rows


def test_sliding_windows_like_brute_force(spark, series):
    df, rows = series
    want = {}
    for r in range(3):
        own = [(t, v) for q, _, t, v in rows if q == r]
        first = own[0][0]
        for k in range(int((own[-1][0] - first) // 10) + 1):
            x = [v for t, v in own if first + k * 10 <= t < first + k * 10 + 45]
            if x:
                want[r, k] = (len(x), np.mean(x), np.std(x, ddof=1) / np.mean(x) if len(x) > 1 else None)
    want[9, 0] = (1, 800.0, None)
    for block in BLOCKS:
        got = {(x.r, x.window_idx): (x.n, x.mean, x.cv) for x in A.time_windows(df, K, "t", "v", 45.0, 10.0, block).collect()}
        assert got.keys() == want.keys()
        for k, (n, m, cv) in want.items():
            assert got[k][0] == n and got[k][1] == pytest.approx(m, abs=1e-9) and (got[k][2] is None if cv is None else got[k][2] == pytest.approx(cv, abs=1e-7)), (block, k)


def test_variability_of_windows_like_each_window_alone(spark, series):
    df, rows = series
    w = spark.createDataFrame([(r, k, k * 37.0, k * 37.0 + 60) for r in (0, 1, 2, 9) for k in range(16)], "r int, k int, a double, b double")
    parts = df.join(w, "r").where("t >= a and t < b")
    plain = {(x.r, x.k): x for x in B.hrv_summary(parts, ["r", "k"], ["t", "i"], "v", 10).collect()}
    for block in BLOCKS:
        got = {(x.r, x.k): x for x in R.window_hrv(df, w, K, ["k"], ["i"], "t", "v", ("a", "b"), 10, block).collect()}
        assert got.keys() == plain.keys() and len(got) > 30
        for k, x in plain.items():
            for c in ("n_rr", "mean_nn", "sdnn", "rmssd", "sdsd", "pnn50", "sd1", "sd2"):
                assert got[k][c] == pytest.approx(x[c], rel=1e-6, abs=1e-6), (block, k, c)


def test_coverage_like_brute_force(spark):
    rng = np.random.default_rng(6)
    spans = lambda n: [(int(rng.integers(0, 3)), i, float(a), float(a + d)) for i, (a, d) in enumerate(zip(np.round(rng.uniform(0, 500, n), 2), np.round(rng.exponential(20, n), 2)))]
    targets, windows = [*spans(80), (1, 80, 5.0, 5.0), (7, 81, 0.0, 9.0)], [*spans(120), (1, 120, 9.0, 9.0)]
    want = {i: sum(max(0.0, min(b, d) - max(a, c)) for q, _, c, d in windows if q == r) / (b - a) if b > a else None for r, i, a, b in targets}
    t, w = spark.createDataFrame(targets, "r int, i int, a double, b double"), spark.createDataFrame(windows, "r int, j int, c double, d double")
    for block in BLOCKS:
        got = {x.i: x.coverage for x in I.coverage(t, w, K, ["i"], ("a", "b"), ("c", "d"), block=block).collect()}
        assert got == {i: v if v is None else pytest.approx(v, abs=1e-8) for i, v in want.items()}, block


# Signal files in parts


def tdms_segment(channels, meta=True, new=True, interleaved=False, blocks=1, big=False, more=()):
    """A segment's bytes; channels: (path, type code, dtype, samples of all blocks, properties)."""
    import struct

    o = ">" if big else "<"
    text_ = lambda s: struct.pack(o + "I", len(s)) + s.encode()
    body = b""
    if meta:
        body = struct.pack(o + "I", len(channels) + len(more))
        for path, code, _, x, props in [*channels, *more]:
            body += text_(path)
            body += struct.pack(o + "I", 0xFFFFFFFF) if x is None else struct.pack(o + "IIIQ", 20, code, 1, len(x) // blocks)
            body += struct.pack(o + "I", len(props)) + b"".join(text_(k) + struct.pack(o + "Id", 10, v) for k, v in props.items())
    raw = b""
    arrays = [np.asarray(x, o + d) for _, _, d, x, _ in channels]
    for i in range(blocks):
        parts = [a[len(a) // blocks * i : len(a) // blocks * (i + 1)] for a in arrays]
        raw += b"".join(a[j : j + 1].tobytes() for j in range(len(parts[0])) for a in parts) if interleaved else b"".join(a.tobytes() for a in parts)
    toc = 1 << 3 | meta << 1 | new << 2 | interleaved << 5 | big << 6
    lead = b"TDSm" + struct.pack("<I", toc) + struct.pack(o + "IQQ", 4713, len(body) + len(raw), len(body))
    return lead + body + raw


@pytest.fixture
def recordings(tmp_path):
    rng = np.random.default_rng(8)
    x = lambda n: np.round(rng.normal(0, 100, n))
    ekg, other = "/'g'/'EKG 1'", "/'g'/'Temp'"
    both = lambda n, d=("f8", 10): [(other, 10, "f8", x(n), {}), (ekg, d[1], d[0], x(n), {})]
    first = [(other, 10, "f8", x(3000), {}), (ekg, 10, "f8", x(3000), {"wf_increment": 1 / 256})]
    parts = [tdms_segment(first, blocks=3, more=[("/", 0, "", None, {"fs": 9.0})]), tdms_segment(both(500), interleaved=True), tdms_segment(both(2000), blocks=2, big=True), tdms_segment(both(700, ("i2", 2)))]
    # raw data as the segment before has it, without meta data
    parts.append(tdms_segment(both(700, ("i2", 2)), meta=False, new=False))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "long.tdms").write_bytes(b"".join(parts))
    (tmp_path / "short.TDMS").write_bytes(tdms_segment([("/'g'/'a'", 3, "i4", range(10), {})]))
    (tmp_path / "none.tdms").write_bytes(b"")
    (tmp_path / "note.txt").write_text("x")
    return tmp_path


def test_a_file_in_parts_like_the_whole_file(spark, recordings):
    from beatlake.sources import binary, tdms_source

    long = str(recordings / "sub" / "long.tdms")
    with open(long, "rb") as f:
        name, fs, start, whole = binary.tdms_channel(f.read())
    assert len(whole) == 6900 and fs == 256 and name == "EKG 1"
    df = tdms_source.read_tdms_parts(spark, str(recordings), chunk=300, part=600)
    rows = sorted((r for r in df.collect() if r.path == long), key=lambda r: r.chunk_idx)
    assert [r.chunk_idx for r in rows] == list(range(len(rows))) and max(len(r.samples) for r in rows) == 300
    assert np.array_equal(np.concatenate([r.samples for r in rows]), whole)
    assert [r.start_sample for r in rows] == [0, *np.cumsum([len(r.samples) for r in rows])[:-1]] and {(r.channel, r.fs, r.start_us) for r in rows} == {(name, fs, start)}
    assert df.rdd.getNumPartitions() >= 12
    assert [r.samples for r in df.collect() if r.path.endswith("short.TDMS")] == [[float(i) for i in range(10)]]


def test_parts_of_a_time_and_a_channel(spark, recordings):
    from beatlake.sources import binary, tdms_source

    long = str(recordings / "sub" / "long.tdms")
    with open(long, "rb") as f:
        _, found = binary.parse_tdms(f.read())
    df = tdms_source.read_tdms_parts(spark, f"file://{long}", "temp", from_s=2.0, to_s=3.5, chunk=256, part=1)
    # the rate of a channel without one is the file's
    assert [(r.start_sample, r.fs) for r in df.orderBy("chunk_idx").collect()] == [(0, 9.0)]
    df = tdms_source.read_tdms_parts(spark, long, from_s=2.0, to_s=3.5, chunk=256, part=1)
    got = df.orderBy("chunk_idx").collect()
    assert [r.start_sample for r in got] == [512, 768] and df.rdd.getNumPartitions() == 2
    assert np.array_equal(np.concatenate([r.samples for r in got]), found["/'g'/'EKG 1'"][512:1024])
    assert tdms_source.read_tdms_parts(spark, long, from_s=1e6).count() == 0


def test_planning_reads_no_samples(recordings):
    from beatlake.sources import binary

    data = (recordings / "sub" / "long.tdms").read_bytes()
    read = []

    def at(place, n):
        read.append(n)
        return data[place : place + n]

    _, found = binary.tdms_layout(at, len(data))
    assert sum(r.n * r.blocks for r in found["/'g'/'EKG 1'"]) == 6900 and sum(read) < 1000


def test_two_versions_of_interval_files(spark, tmp_path):
    from beatlake.plans import studies

    rng = np.random.default_rng(4)
    rr = np.round(rng.uniform(600, 1100, 400), 1)
    head = lambda clock: ["Date\t2023/05/04", f"Time\t{clock}", *["x"] * 20]
    body = lambda v: [f"{i}\t{str(x).replace('.', ',')}" for i, x in enumerate(v)]
    for folder, clock, values in (("whole", "10:00:00,000", rr), ("trimmed", "10:00:01,500", rr[:390])):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "p1.lvm").write_text("\n".join(head(clock) + body(values)))
    a, b = studies.read_versions(spark, str(tmp_path / "whole"), str(tmp_path / "trimmed"))
    r = studies.compare_versions(a, b, ["recording"], "t", "rr", [round(-2 + 0.05 * i, 2) for i in range(81)], tol_rr=0.02).collect()
    assert len(r) == 1 and r[0].recording == "p1.lvm" and r[0].best_delta == -1.5
    assert (r[0].tp, r[0].fn, r[0].fp, r[0].n_common) == (390, 10, 0, 390) and r[0].rr_mae_ms == pytest.approx(0, abs=1e-6)


def test_detectors_are_ranked_with_those_that_find_little(spark):
    from beatlake.plans import studies

    ref = spark.createDataFrame([(r, float(t)) for r in (1, 2) for t in range(10)], "r int, t double")
    found = [(r, "good", t + 0.01) for r in (1, 2) for t in range(10)] + [(1, "half", t + 0.02) for t in range(0, 10, 2)] + [(2, "wild", t + 0.5) for t in range(30)]
    tests = spark.createDataFrame([(r, n, float(t)) for r, n, t in found], "r int, name string, t double")
    got = studies.rank_detectors(ref, tests, K, ["name"], "t", 0.04).orderBy("rank").collect()
    assert [(x.name, x.tp, x.fn, x.fp) for x in got] == [("good", 20, 0, 0), ("half", 5, 15, 0), ("wild", 0, 20, 30)]


def test_classes_at_points_like_a_scan(spark):
    rng = np.random.default_rng(3)
    iv = [("f", i, int(a), int(a + d), int(rng.integers(1, 4))) for i, (a, d) in enumerate(zip(rng.integers(0, 900, 60), rng.integers(1, 200, 60)))]
    rows = spark.createDataFrame(iv, "path string, ord bigint, start bigint, end bigint, class bigint")
    points = spark.createDataFrame([("f", t) for t in range(1200)], "path string, t bigint")
    want = [next((c for _, _, a, b, c in reversed(iv) if a <= t < b), 0) for t in range(1200)]
    assert [r["class"] for r in text.class_at(rows, points, "t").orderBy("t").collect()] == want


def test_scratch_tables_go_when_closed(spark):
    import os

    from beatlake.scratch import Scratch

    with Scratch(spark, "test") as scratch:
        kept = scratch.save(spark.range(5))
        folder = scratch.root.removeprefix("file://")
        assert kept.count() == 5 and os.path.isdir(folder)
    assert not os.path.exists(folder)

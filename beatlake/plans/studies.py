"""Whole studies as lazy plans over the engine's operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatlake.operators import beats, events, intervals, matching, quality, scoring, segments, signal, thresholds
from beatlake.schema import assert_unique, require_columns
from beatlake.scratch import Scratch

SERIES = ["recording_uid", "patient_id", "algo_id", "rr_source"]


@dataclass(frozen=True)
class DetectionConfig:
    n_beats: int = 100
    gap_s: float = 180.0
    pad_s: float = 300.0
    factor: float = 1.05
    segments: tuple[tuple[str, float | None], ...] = (("first_24h", 86400.0), ("first_12h", 43200.0), ("first_half", None))
    value: str = "ModCSI_x_Slope"
    responders: tuple[int, ...] = ()
    calibrate_on: str = "labview"


def rr_series(pairs: DataFrame) -> DataFrame:
    """One row a beat and source (labview, python) from aligned pairs with recording_uid."""
    both = F.array(F.struct(F.lit("labview").alias("rr_source"), F.col("rr_labview_s").alias("rr")), F.struct(F.lit("python").alias("rr_source"), F.col("rr_python_s").alias("rr")))
    return pairs.select("recording_uid", "patient_id", "algo_id", "ord", F.explode(both).alias("s")).select("recording_uid", "patient_id", "algo_id", "ord", "s.*")


def detection_study(pairs: DataFrame, recordings: DataFrame, windows: DataFrame, truth: DataFrame, cfg: DetectionConfig = DetectionConfig(), given: DataFrame | None = None) -> dict[str, DataFrame]:
    """features, thresholds, events, scores and responder split of aligned interval files.

    Everything stays keyed by recording: one shuffle brings a series' beats
    together. Features and events are read by many branches, so each is
    written once to the shared folder.
    """
    scratch = Scratch(pairs.sparkSession, "study")
    require_columns(pairs, "patient_id", "enrollment_id", "recording_id", "algo_id", "ord")
    known = intervals.null_safe_lookup(pairs, recordings, ["patient_id", "enrollment_id", "recording_id"], ["recording_uid"], ["recording_uid"]).where("recording_uid is not null")
    feats = beats.seizure_features(rr_series(known), SERIES, ["ord"], "rr", cfg.n_beats)
    span = windows.agg(F.min(F.col("win_end_s") - F.col("win_start_s")).alias("a"), F.max(F.col("win_end_s") - F.col("win_start_s")).alias("b")).first()
    if span["a"] is not None and span["b"] - span["a"] > 1e-6:
        raise ValueError("windows of different lengths")
    length = span["b"] or 60.0
    w = intervals.overlap_flag(windows, truth, ["recording_uid"], ["window_idx"], ("win_start_s", "win_end_s"), ("t0", "t1"), out="window_overlaps_seizure")
    w = scratch.save(w)
    feats = intervals.floor_window(feats, assert_unique(w, "recording_uid", "window_idx"), ["recording_uid"], "t_s", length, ["is_acceptable", "window_overlaps_seizure"])
    feats = scratch.save(feats)
    thr = thresholds.segment_thresholds(feats.where(F.col("rr_source") == cfg.calibrate_on), truth, "patient_id", "recording_uid", "t_s", cfg.value, ("t0", "t1"), dict(cfg.segments), cfg.factor, fallback=given)
    thr = scratch.save(thr)
    marked = scratch.save(thresholds.attach(feats, thr, "patient_id"))
    modes = scoring.with_sqi_modes(marked, "is_acceptable", {"off": None, "on": "is_acceptable"})
    by = ["rr_source", "algo_id", "sqi"]
    found = scratch.save(events.event_list(modes, [*by, "recording_uid", "patient_id"], ["ord"], "t_s", cfg.value, F.col("threshold"), cfg.gap_s))
    used = truth.select("recording_uid", "t0", "t1").join(modes.select(*by, "recording_uid", "patient_id").distinct(), "recording_uid")
    used = scratch.save(used)
    hours = scoring.analyzable_hours(windows, ["recording_uid"], ("win_start_s", "win_end_s"))
    score = lambda f, u, g, overall=None: scoring.score(f, u, "recording_uid", ("t_start", "t_end"), ("t0", "t1"), cfg.pad_s, hours, g, overall)
    split = lambda df: scoring.responders(df, "patient_id", list(cfg.responders))
    return {"features": marked, "thresholds": thr, "events": found, "scores": score(found, used, by), "responder_scores": score(split(found), split(used), [*by, "is_responder"], "is_responder")}


def retention_study(windows: DataFrame, truth: DataFrame) -> dict[str, DataFrame]:
    """Windows kept by recording, by event, and flag shares."""
    w = quality.acceptable(windows)
    length = F.col("win_end_s") - F.col("win_start_s")
    axis = ("win_start_s", "win_end_s")
    w = intervals.overlap_flag(w, truth, ["recording_uid"], ["window_idx"], axis, ("t0", "t1"), out="overlaps_event")
    pairs = intervals.overlap_pairs(w, truth, ["recording_uid"], axis, ("t0", "t1"))
    flags = [f for f in ("is_flatline", "is_noiseburst", "is_clipping") if f in w.columns]
    return {
        "by_recording": quality.retention(w, ["recording_uid"], length, "is_acceptable", "overlaps_event"),
        "by_event": quality.retention_by_event(pairs, ["recording_uid"], ["window_idx"], ["t0", "t1"], "is_acceptable"),
        "flags": quality.flag_table(w, flags, "overlaps_event"),
    }


def compare_peaks(ref: DataFrame, test: DataFrame, keys: list[str], t: str = "t", tol: float = 0.04, refine: bool = True, block: float | None = None) -> dict[str, DataFrame]:
    """Match metrics of two peak trains for all recordings (and methods) at once: common range, median shift, greedy match, error log, interval agreement."""
    span = intervals.common_range(ref, test, keys, t)
    a, b = (intervals.crop(x, span, keys, t, "overlap_start", "overlap_end") for x in (ref, test))
    shift = matching.nearest_shift(intervals.nearest(b, a, keys, t, t, block=block), keys)
    moved = b.join(shift.select(*keys, "delta"), keys, "left").withColumn(t, F.col(t) + F.coalesce("delta", F.lit(0.0))).drop("delta")
    matched = matching.greedy_match(a, moved, keys, t, tol)
    if refine:
        more = matching.refined_shift(matched, keys)
        moved = moved.join(more.withColumnRenamed("delta", "_m"), keys, "left").withColumn(t, F.col(t) - F.coalesce("_m", F.lit(0.0))).drop("_m")
        matched = matching.greedy_match(a, moved, keys, t, tol)
    rr = lambda x: beats.rr_from_peaks(x, keys, [t], t)
    common = matching.band_match(rr(a), rr(moved), keys, t, tol)
    common = common.join(rr(a).select(*keys, F.col(t).alias("t_ref"), F.col("rr").alias("rr_ref")), [*keys, "t_ref"]).join(rr(moved).select(*keys, F.col(t).alias("t_test"), F.col("rr").alias("rr_test")), [*keys, "t_test"])
    return {"shift": shift, "matched": matched, "metrics": matching.metrics(matched, keys), "errors": matching.error_log(matched, 60.0, tol), "agreement": matching.rr_agreement(common, keys, "rr_ref", "rr_test")}


def compare_versions(ref: DataFrame, test: DataFrame, keys: list[str], t: str, rr: str, deltas: list[float], tol_rr: float = 0.15, tol: float = 0.04, least: int = 5) -> DataFrame:
    """Two versions of a recording's beats, for all recordings at once: the delta at which their intervals agree best, the agreement there, and the match of the beats moved by it (by 0 where too few intervals match)."""
    best = matching.rr_delta_search(ref, test, keys, t, rr, deltas, tol_rr, least)
    moved = test.join(best.select(*keys, "best_delta"), keys, "left").withColumn(t, F.col(t) + F.coalesce("best_delta", F.lit(0.0))).drop("best_delta")
    scores = matching.metrics(matching.greedy_match(ref, moved, keys, t, tol), keys).select(*keys, "tp", "fn", "fp", "sens", "ppv", "f1")
    return scores.join(best.select(*keys, "best_delta", F.col("mae_ms").alias("rr_mae_ms"), F.col("n").alias("n_common")), keys, "left").withColumns({"best_delta": F.coalesce("best_delta", F.lit(0.0)), "n_common": F.coalesce("n_common", F.lit(0))})


def read_versions(spark, ref: str, test: str) -> tuple[DataFrame, DataFrame]:
    """path, t, rr of beats in two LabVIEW interval files (or folders of files with equal names): times from each file's start."""
    from beatlake.sources import text

    name = F.regexp_extract("path", r"([^/]+)$", 1)
    out = []
    for path in (ref, test):
        start = text.read_lvm_start(spark, path).select(name.alias("recording"), (F.unix_micros(F.col("start").cast("timestamp")) / 1e6).alias("_start"))
        x = text.running(text.read_lvm_rr(spark, path).withColumnRenamed("ord", "line"), ["path"], {"_t": F.col("rr")})
        x = x.select(name.alias("recording"), "rr", (F.col("_t") - F.col("rr")).alias("_t"))
        out.append(x.join(start, "recording", "left").select("recording", (F.coalesce("_start", F.lit(0.0)) + F.col("_t")).alias("t"), "rr"))
    return out[0], out[1]


def rank_detectors(ref: DataFrame, tests: DataFrame, keys: list[str], variants: list[str], t: str, tol: float) -> DataFrame:
    """Detectors (and cleanings) from the best to the worst F1 over all recordings: `tests` has the beats of every variant, all are matched in one plan, and one that found nothing has its misses."""
    every = tests.select(F.collect_set(F.struct(*variants))).scalar()  # a few names
    spread = ref.select(*keys, t).withColumn("_every", every).select(*keys, t, F.explode("_every").alias("_v")).select(*keys, t, "_v.*")
    return matching.ranked(matching.pooled(matching.metrics(matching.greedy_match(spread, tests, [*keys, *variants], t, tol), [*keys, *variants]), variants), variants)


def signal_study(chunks: DataFrame, keys: list[str], fs: float, n_beats: int = 100, low: float = 1.2, high: float = 32.0, method: str = "two_level", quantile: float = 0.995) -> dict[str, DataFrame]:
    """From signal segments to detections: band-pass, peaks, intervals, features, thresholds, merged events."""
    clean = signal.band_pass(chunks, keys, "samples", fs, low, high)
    peaks = signal.detect_peaks(clean, keys, "samples", fs, method).withColumn("t", F.col("sample") / fs)
    rr = beats.rr_from_peaks(peaks, keys, ["t"])
    feats = beats.lorenz_features(rr, keys, ["t"], "rr", "t", n_beats)
    found = None
    for c in ("CSI", "ModCSI"):
        thr = thresholds.quantile_threshold(feats, keys, c, quantile, out="_thr")
        one = events.ordinal_events(feats.join(thr, keys), keys, [], "t", F.col(c) >= F.col("_thr")).select(*keys, "t_start", "t_end")
        found = one if found is None else found.unionByName(one)
    return {"peaks": peaks, "rr": rr, "features": feats, "events": events.merge_overlaps(found, keys)}


def labelled_noise(chunks: DataFrame, labels: DataFrame, keys: list[str], fs: float, window: str = "window_idx") -> DataFrame:
    """Noise features of labelled windows, summed up by recording and class (1 to 3 always there)."""
    from beatlake.operators.summaries import class_summary

    feats = signal.noise_features(chunks, [*keys, window], "samples", fs)
    return class_summary(feats.join(labels, [*keys, window]), keys, "label", [1, 2, 3], ["rms", "bw_ratio", "hf_ratio", "pl_ratio", "zcr"])


def around_events(chunks: DataFrame, truth: DataFrame, keys: list[str], fs: float, half: float = 300.0) -> DataFrame:
    """Slices of ±half around onsets, with wavelet energies by level."""
    spans = segments.to_samples(truth.withColumns({"_a": F.greatest(F.col("t0") - half, F.lit(0.0)), "_b": F.col("t0") + half}), ("_a", "_b"), F.lit(fs), F.lit(1 << 60))
    cut = segments.slices(chunks, spans, keys, ["event_id"], "i0", "i1")
    return signal.wavelet_energy(cut, [*keys, "event_id"], "samples")


def trim_table(chunks: DataFrame, keys: list[str], fs: float, window_s: float = 10.0, factor: float = 3.0, k: int = 6, edge: int = 360) -> DataFrame:
    """trim_start_s and trim_end_s of recordings: the first and last long enough run of windows whose rms isn't far above the median."""
    n = int(window_s * fs)
    rows = chunks.select(*keys, F.posexplode("samples").alias("_i", "x"), "start_sample").withColumn("window_idx", F.floor((F.col("start_sample") + F.col("_i")) / n).cast("bigint"))
    w = rows.groupBy(*keys, "window_idx").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    mid = w.groupBy(*keys).agg(F.median("rms").alias("_m"), F.max("window_idx").alias("_last"))
    x = w.join(mid, keys)
    points = events.trim_points(x, keys, "window_idx", F.col("rms") > factor * F.col("_m"), k, edge)
    out = points.join(mid, keys)
    return out.select(*keys, (F.coalesce("trim_first", F.lit(0)) * window_s).alias("trim_start_s"), ((F.col("_last") - F.coalesce("trim_last", "_last")) * window_s).alias("trim_end_s"))

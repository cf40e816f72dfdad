"""Signal operators on rows of samples: filters, spectra, noise and quality features, wavelets, peaks.

A row is a segment (keys, samples). Long recordings come in chunks;
`with_margins` joins each chunk to the ends of its neighbours, so filters run
on chunks in parallel and only lose what decays within the margin.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beatlake.functions import kernels as K
from beatlake.operators.quantiles import quantiles
from beatlake.operators.summaries import top_n

Keys = list[str]
# Bands in Hz.
BANDS = {"ulf": (0.0, 0.5), "lf": (0.5, 5.0), "qrs": (5.0, 15.0), "hf": (15.0, 40.0), "line": (49.0, 51.0)}


def per_segment(df: DataFrame, keys: Keys, col: str, fields: str, fn: Callable[[np.ndarray], dict]) -> DataFrame:
    """One kernel call for each row's samples; a null or empty array gives nulls."""
    names = [f.split(" ")[0] for f in fields.split(", ")]
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in (df.schema[k] for k in keys))

    def run(batches):
        for pdf in batches:
            rows = [fn(np.asarray(x, float)) if x is not None and len(x) else dict.fromkeys(names) for x in pdf[col]]
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    return df.select(*keys, col).mapInPandas(run, f"{kept}, {fields}")


def with_margins(chunks: DataFrame, keys: Keys, margin: int, order: str = "chunk_idx", col: str = "samples") -> DataFrame:
    """Adds `padded` (the chunk between the ends of its neighbours) and `lead`, how many samples stand before it."""
    w = W.partitionBy(*keys).orderBy(order)
    empty = F.array().cast("array<double>")
    before, after = F.coalesce(F.lag(col).over(w), empty), F.coalesce(F.lead(col).over(w), empty)
    x = chunks.withColumns({"_b": before, "_a": after})
    head = F.when(F.size("_b") > margin, F.slice("_b", F.size("_b") - margin + 1, margin)).otherwise(F.col("_b"))
    return x.withColumns({"padded": F.concat(head, F.col(col), F.slice("_a", 1, margin)), "lead": F.size(head)}).drop("_b", "_a")


def filter_chunks(chunks: DataFrame, keys: Keys, sos: np.ndarray, margin: int, order: str = "chunk_idx", col: str = "samples") -> DataFrame:
    """Zero-phase filtering of chunked recordings, chunk by chunk."""
    x = with_margins(chunks, keys, margin, order, col).withColumn("_n", F.size(col))
    kept = [*keys, order]
    fields = ", ".join(f"{k} {chunks.schema[k].dataType.simpleString()}" for k in kept)

    def run(batches):
        for pdf in batches:
            done = [K.zero_phase(np.asarray(p, float), sos)[a : a + n].tolist() for p, a, n in zip(pdf["padded"], pdf["lead"], pdf["_n"])]
            yield pdf[kept].assign(**{col: done})

    return x.select(*kept, "padded", "lead", "_n").mapInPandas(run, f"{fields}, {col} array<double>")


def band_pass(df: DataFrame, keys: Keys, col: str, fs: float, low: float, high: float, order: int = 2) -> DataFrame:
    sos = K.butter_sections(order, (low, high), fs, "band")
    return per_segment(df, keys, col, f"{col} array<double>", lambda x: {col: K.zero_phase(x, sos).tolist()})


def low_pass(df: DataFrame, keys: Keys, col: str, fs: float, cutoff: float, order: int = 4) -> DataFrame:
    sos = K.butter_sections(order, (cutoff,), fs, "low")
    return per_segment(df, keys, col, f"{col} array<double>", lambda x: {col: K.zero_phase(x, sos).tolist()})


def notch_comb(df: DataFrame, keys: Keys, col: str, fs: float, line: float = 50.0, q: float = 30.0, harmonics: int = 3) -> DataFrame:
    sos = np.concatenate([K.notch_section(line * h, fs, q) for h in range(1, harmonics + 1) if line * h < fs / 2] or [np.array([[1.0, 0, 0, 1, 0, 0]])])
    return per_segment(df, keys, col, f"{col} array<double>", lambda x: {col: K.zero_phase(x, sos).tolist()})


def quality_preprocess(df: DataFrame, keys: Keys, col: str, fs: float, trim_s: float = 60.0) -> DataFrame:
    """Trim both ends, band-pass 0.5 to 40 Hz, notch at 50 Hz."""
    n = int(trim_s * fs)
    sos = np.concatenate([K.butter_sections(2, (0.5, min(40.0, 0.45 * fs)), fs, "band"), *([K.notch_section(50.0, fs)] if fs > 100 else [])])
    return per_segment(df, keys, col, f"{col} array<double>", lambda x: {col: K.zero_phase(x[n : len(x) - n], sos).tolist() if len(x) > 2 * n + 12 else []})


def resampled(df: DataFrame, keys: Keys, col: str, fs: float, target: float) -> DataFrame:
    return per_segment(df, keys, col, f"{col} array<double>", lambda x: {col: K.resample(x, fs, target).tolist()})


def decimated(x: Column, stride: int) -> Column:
    """Every stride-th sample."""
    return F.filter(x, lambda _, i: i % stride == 0)


def polarity(x: Column) -> Column:
    """-1 where the fifth percentile is further from zero than the ninety-fifth."""
    s, n = F.array_sort(x), F.size(x)
    at = lambda q: s[F.floor((n - 1) * q).cast("int")]
    return F.when(F.abs(at(0.05)) > at(0.95), -1).otherwise(1)


def psd(df: DataFrame, keys: Keys, col: str, fs: float, nperseg: int) -> DataFrame:
    def one(x):
        f, p = K.welch(x, fs, nperseg)
        return {"f": f.tolist(), "p": p.tolist()}

    return per_segment(df, keys, col, "f array<double>, p array<double>", one)


def band_powers(psds: DataFrame, keys: Keys, bands: dict[str, tuple[float, float]] = BANDS) -> DataFrame:
    """A row for each band with its power (trapezoids over the bins within) and share of all; functions on arrays only."""
    spine = F.array(*(F.struct(F.lit(b).alias("band"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for b, (lo, hi) in bands.items()))
    x = psds.withColumn("_b", F.explode(spine))

    def area(lo: Column, hi: Column) -> Column:
        step = F.arrays_zip(F.slice("f", 1, F.size("f") - 1).alias("f0"), F.slice("f", 2, F.size("f") - 1).alias("f1"), F.slice("p", 1, F.size("p") - 1).alias("p0"), F.slice("p", 2, F.size("p") - 1).alias("p1"))
        inside = F.filter(step, lambda s: (s["f0"] >= lo) & (s["f1"] <= hi))
        return F.aggregate(inside, F.lit(0.0), lambda a, s: a + (s["f1"] - s["f0"]) * (s["p0"] + s["p1"]) / 2)

    x = x.select(*keys, F.col("_b.band").alias("band"), area(F.col("_b.lo"), F.col("_b.hi")).alias("power"), area(F.lit(0.0), F.lit(1e12)).alias("_all"))
    return x.select(*keys, "band", "power", (F.col("power") / F.when(F.col("_all") > 0, F.col("_all"))).alias("share"))


def dft_power(x: Column) -> Column:
    """Power of each frequency bin 0..n/2 by the sums of the transform's definition, for short segments."""
    n = F.nullif(F.size(x), F.lit(0))
    idx = F.sequence(F.lit(0), n - 1)
    pairs = F.arrays_zip(x.alias("x"), idx.alias("i"))
    part = lambda k, fn: F.aggregate(pairs, F.lit(0.0), lambda a, s: a + s["x"] * fn(2 * np.pi * ((k * s["i"]) % n) / n))
    return F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int")), lambda k: part(k, F.cos) * part(k, F.cos) + part(k, F.sin) * part(k, F.sin))


def noise_features(df: DataFrame, keys: Keys, col: str, fs: float, line: float = 50.0) -> DataFrame:
    """rms, baseline-wander, high-frequency and line ratios, zero-crossing rate, as a signal-to-noise proxy too."""

    def one(x):
        f, p = K.welch(x, fs, max(128, int(fs)))
        total = float(np.trapezoid(p, f)) or 1e-12
        y = x - x.mean()
        qrs = K.band_power(f, p, 5, 15)
        hf = K.band_power(f, p, 40, fs / 2)
        return {
            "rms": float(np.sqrt(np.mean(x**2))), "bw_ratio": K.band_power(f, p, 0.1, 0.5) / total, "hf_ratio": hf / total,
            "pl_ratio": K.band_power(f, p, line - 1, line + 1) / total, "zcr": float(np.mean(np.signbit(y[1:]) != np.signbit(y[:-1]))) if len(y) > 1 else 0.0,
            "snr_db": 10 * np.log10(max(qrs, 1e-12) / max(hf, 1e-12)),
        }

    return per_segment(df, keys, col, "rms double, bw_ratio double, hf_ratio double, pl_ratio double, zcr double, snr_db double", one)


def composite_sqi(snr: Column, baseline: Column, line: Column, flat: Column, clipped: Column) -> Column:
    """Weighted score: signal-to-noise .40, baseline .20, line .15, flatline .15, clipping .10."""
    unit = lambda c, lo, hi: F.least(F.greatest((c - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
    return 0.40 * unit(snr, 0, 20) + 0.20 * (1 - unit(baseline, 0.05, 0.5)) + 0.15 * (1 - unit(line, 0.01, 0.2)) + 0.15 * (1 - unit(flat, 0, 0.3)) + 0.10 * (1 - unit(clipped, 0, 0.1))


def preservation(df: DataFrame, keys: Keys, before: str, after: str, fs: float, cutoff: float) -> DataFrame:
    """Correlation of two versions of a segment below a cutoff, and the rms of their difference over the first one's p95."""
    sos = K.butter_sections(4, (cutoff,), fs, "low")
    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for pdf in batches:
            out = []
            for a, b in zip(pdf[before], pdf[after]):
                a, b = (K.zero_phase(np.asarray(v, float), sos) for v in (a, b))
                same = a.std() > 0 and b.std() > 0
                out.append((float(np.corrcoef(a, b)[0, 1]) if same else np.nan, float(np.sqrt(np.mean((a - b) ** 2)) / max(np.percentile(np.abs(a), 95), 1e-12))))
            yield pdf[keys].assign(corr=[o[0] for o in out], nrmse=[o[1] for o in out])

    return df.select(*keys, before, after).mapInPandas(run, f"{fields}, corr double, nrmse double")


def spectrogram(df: DataFrame, keys: Keys, col: str, fs: float, length: float, hop: float) -> DataFrame:
    """A row for each frame: its time and the magnitudes of its spectrum."""
    n, h = int(length * fs), max(1, int(hop * fs))

    def one(x):
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
        parts = np.lib.stride_tricks.sliding_window_view(x, n)[::h] if len(x) >= n else np.zeros((0, n))
        return {"frames": [[i * h / fs, *m] for i, m in enumerate(np.abs(np.fft.rfft(parts * window)).tolist())]}

    x = per_segment(df, keys, col, "frames array<array<double>>", one).select(*keys, F.explode("frames").alias("_f"))
    return x.select(*keys, F.col("_f")[0].alias("t_frame"), F.slice("_f", 2, F.size("_f") - 1).alias("magnitude"))


def scalogram(df: DataFrame, keys: Keys, col: str, fs: float, freqs: list[float]) -> DataFrame:
    """Mean wavelet magnitude by frequency."""
    x = per_segment(df, keys, col, "m array<double>", lambda v: {"m": K.morlet_scalogram(v, fs, np.array(freqs)).mean(1).tolist()})
    return x.select(*keys, F.posexplode("m").alias("_i", "magnitude")).select(*keys, F.element_at(F.array(*(F.lit(float(f)) for f in freqs)), F.col("_i") + 1).alias("freq"), "magnitude")


def wavelet_energy(df: DataFrame, keys: Keys, col: str, levels: int = 4) -> DataFrame:
    """Energy of each db4 detail level (1 is finest) and of the rest (0)."""
    x = per_segment(df, keys, col, "e array<double>", lambda v: {"e": [float((d**2).sum()) for d in K.dwt_levels(v, levels)]})
    x = x.select(*keys, F.size("e").alias("_n"), F.posexplode("e").alias("_i", "energy"))
    return x.select(*keys, F.when(F.col("_i") == F.col("_n") - 1, 0).otherwise(F.col("_i") + 1).alias("level"), "energy")


def wavelet_band(df: DataFrame, keys: Keys, col: str, level: int, levels: int = 4) -> DataFrame:
    """Each segment rebuilt from one db4 level alone (1 is finest, 0 the rest)."""
    return per_segment(df, keys, col, f"{col} array<double>", lambda x: {col: K.dwt_band(x, level, levels).tolist()})


def amplitude_ratio(df: DataFrame, keys: Keys, col: str, fs: float) -> DataFrame:
    """Median R over median T amplitude of each segment; null for too few peaks."""
    x = per_segment(df, keys, col, "rt_ratio double", lambda v: {"rt_ratio": K.wave_ratio(v, fs)})
    return x.withColumn("rt_ratio", F.nanvl("rt_ratio", F.lit(None).cast("double")))


def detect_peaks(df: DataFrame, keys: Keys, col: str, fs: float, method: str = "two_level", **settings) -> DataFrame:
    """A row for each peak (sample index within the segment), by one of the registered detectors."""
    fn = DETECTORS[method]
    x = per_segment(df, keys, col, "peaks array<bigint>", lambda v: {"peaks": fn(v, fs, **settings).tolist()})
    return x.select(*keys, F.explode("peaks").alias("sample"))


DETECTORS: dict[str, Callable[..., np.ndarray]] = {
    "two_level": K.two_level_peaks,
    "high_only": lambda x, fs: K.two_level_peaks(x, fs, look_back=False),
    "energy": K.energy_peaks,
    "prominence": lambda x, fs, distance_s=0.3, prominence=0.5: K.prominent_peaks(x, max(1, int(distance_s * fs)), prominence * float(np.std(x))),
}


def register_detector(name: str, fn: Callable[..., np.ndarray]) -> None:
    """Adds a detector: fn(samples, fs, **settings) to sample indices."""
    DETECTORS[name] = fn


def teager(rows: DataFrame, keys: Keys, order: str, x: str, out: str = "tkeo") -> DataFrame:
    """The energy operator x[n]^2 - x[n-1] x[n+1], as a window function over one row a sample."""
    w = W.partitionBy(*keys).orderBy(order)
    return rows.withColumn(out, F.col(x) * F.col(x) - F.lag(x).over(w) * F.lead(x).over(w))


def fir(rows: DataFrame, keys: Keys, order: str, x: str, taps: list[float], out: str) -> DataFrame:
    """A symmetric finite filter as a weighted sum over a frame, zeros beyond the ends."""
    w, half = W.partitionBy(*keys).orderBy(order), len(taps) // 2
    parts = [F.coalesce(F.lag(x, i - half).over(w) if i >= half else F.lead(x, half - i).over(w), F.lit(0.0)) * t for i, t in enumerate(taps)]
    return rows.withColumn(out, sum(parts[1:], parts[0]))


def lag_between(df: DataFrame, keys: Keys, a: str, b: str) -> DataFrame:
    """The shift in samples of one signal against another."""
    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for pdf in batches:
            yield pdf[keys].assign(lag=[K.cross_lag(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(pdf[a], pdf[b])])

    return df.select(*keys, a, b).mapInPandas(run, f"{fields}, lag bigint")


def qc_metrics(x: Column, limit: float = 1e-6) -> dict[str, Column]:
    """rms, deviation and share of flat steps of a segment."""
    n = F.nullif(F.size(x), F.lit(0))
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
    steps = F.zip_with(F.slice(x, 2, n - 1), F.slice(x, 1, n - 1), lambda b, a: F.abs(b - a) < limit)
    return {"rms": F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / n), "std": F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n), "flat_pct": 100.0 * F.size(F.filter(steps, lambda s: s)) / F.nullif(n - 1, F.lit(0))}


def spectral_uniqueness(psds: DataFrame, keys: Keys) -> DataFrame:
    """Root mean square of each segment's log spectrum against the median spectrum of all."""
    x = psds.select(*keys, F.posexplode("p").alias("bin", "power")).withColumn("lp", F.log10(F.greatest("power", F.lit(1e-20))))
    mid = quantiles(x, ["bin"], {"_m": ("lp", 0.5)}, every=False)
    return x.join(mid, "bin").groupBy(*keys).agg(F.sqrt(F.avg((F.col("lp") - F.col("_m")) ** 2)).alias("uniqueness"))


def psd_bands(psds: DataFrame) -> DataFrame:
    """Percentiles of all segments' power by bin."""
    x = psds.select(F.posexplode("p").alias("bin", "power"))
    return quantiles(x, ["bin"], {"p10": ("power", 0.1), "p50": ("power", 0.5), "p90": ("power", 0.9)}, every=False)


def power_outliers(psds: DataFrame, keys: Keys, band: tuple[float, float] = (45.0, 55.0), k: int = 8, by: Keys = ()) -> DataFrame:
    """The k segments (of each group) with most power in a band, by default around the mains: keys, power, rank; equal powers by keys. Each task keeps its k best."""
    x = band_powers(psds, [*keys, *(c for c in by if c not in keys)], {"band": band}).drop("band", "share")
    best = top_n(x, list(by), [F.desc("power"), *keys], k)
    return best if by else best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("power"), *keys)))

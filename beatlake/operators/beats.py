"""Beat-count sliding features over peak times and RR intervals.

Each function adds columns to rows keyed by `keys` (one recording) and sorted
by `order`; all frames of a recording share one exchange and sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beatlake.functions.scalars import TINY, heart_rate

Keys = list[str]


def series(keys: Keys, order: list[str]) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(*order)


def rr_from_peaks(peaks: DataFrame, keys: Keys, order: list[str], t: str = "t") -> DataFrame:
    """Intervals between successive peaks, at the time of the second; the first peak has none."""
    return peaks.withColumn("rr", F.col(t) - F.lag(t).over(series(keys, order))).where("rr is not null")


def time_from_rr(rr: DataFrame, keys: Keys, order: list[str], col: str = "rr", t0: float = 0.0, fs: float | None = None) -> DataFrame:
    """Beat times as the running sum of intervals; in samples too, rounded half to even, where fs is given."""
    out = rr.withColumn("t_beat", t0 + F.sum(col).over(series(keys, order).rowsBetween(W.unboundedPreceding, 0)))
    return out if fs is None else out.withColumn("sample", F.rint(F.col("t_beat") * fs).cast("bigint"))


def clean_rr(rr: DataFrame, col: str = "rr", low: float = 0.25, high: float = 2.5) -> DataFrame:
    """Plausible intervals; those dropped leave no gap in a time axis made from sums."""
    return rr.where(F.col(col).between(low, high))


def normalised_rr(rr: DataFrame, keys: Keys, col: str = "rr") -> DataFrame:
    """Intervals in seconds whatever their unit, told by the recording's median: microseconds above 10000, milliseconds above 5 (or below 0.02: a thousandth)."""
    unit = rr.groupBy(*keys).agg(F.median(col).alias("_median"))
    m = F.col("_median")
    factor = F.when(m > 10_000, 1e-6).when(m > 5, 1e-3).when(m < 0.02, 1e3).otherwise(1.0)
    return rr.join(unit, keys).withColumn(col, F.col(col) * factor).drop("_median")


def median_beats(rr: DataFrame, keys: Keys, order: list[str], col: str = "rr", width: int = 7, mode: str = "edge", out: str = "rr_med") -> DataFrame:
    """Running median of `width` beats.

    edge: centred, ends repeated, series shorter than `width` unchanged.
    edge_always: the same without that exception. trailing: of the beats so
    far, at most `width`. shrink: centred over the beats there are.
    """
    half, w = width // 2, series(keys, order)
    if mode == "trailing":
        return rr.withColumn(out, F.percentile(col, F.lit(0.5)).over(w.rowsBetween(1 - width, 0)))
    if mode == "shrink":
        return rr.withColumn(out, F.percentile(col, F.lit(0.5)).over(w.rowsBetween(-half, half)))
    whole = W.partitionBy(*keys)
    near = F.collect_list(col).over(w.rowsBetween(-half, half))
    n, i = F.count(F.lit(1)).over(whole), F.row_number().over(w)
    first = F.first(col).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    last = F.last(col).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    staged = rr.select("*", near.alias("_near"), n.alias("_n"), i.alias("_i"), first.alias("_first"), last.alias("_last"))
    before = F.array_repeat("_first", F.greatest(F.lit(half + 1) - F.col("_i"), F.lit(0)).cast("int"))
    after = F.array_repeat("_last", F.greatest(F.lit(half) - (F.col("_n") - F.col("_i")), F.lit(0)).cast("int"))
    middle = F.sort_array(F.concat(before, "_near", after))[half]
    value = F.when(F.col("_n") < width, F.col(col)).otherwise(middle) if mode == "edge" else middle
    return staged.withColumn(out, value).drop("_near", "_n", "_i", "_first", "_last")


def poincare(rr: DataFrame, keys: Keys, order: list[str], col: str = "rr_ms", n: int = 100, prefix: str = "", formula: str = "rotated") -> DataFrame:
    """SD1 and SD2 of the last n intervals, for beats that have that many.

    rotated: deviations of successive differences and sums over the square
    root of two. sdnn: from the deviation of the intervals and of the
    differences, clamped at 0. rolling: population deviations of the rotated
    points, null where not positive. classic: SD2 from twice the intervals'
    variance less that of SD1.
    """
    w = series(keys, order)
    d, s = F.col(col) - F.lag(col).over(w), F.col(col) + F.lag(col).over(w)
    pairs, beats = w.rowsBetween(2 - n, 0), w.rowsBetween(1 - n, 0)
    staged = rr.select("*", d.alias("_d"), s.alias("_s"), F.row_number().over(w).alias("_i"))
    root = F.sqrt(F.lit(2.0))
    if formula == "rotated":
        sd1, sd2 = F.stddev_samp("_d").over(pairs) / root, F.stddev_samp("_s").over(pairs) / root
    elif formula == "rolling":
        sd1, sd2 = (F.stddev_pop(c).over(pairs) / root for c in ("_d", "_s"))
        sd1, sd2 = F.when(sd1 > 0, sd1), F.when(sd2 > 0, sd2)
    else:
        nn, dd = F.stddev_samp(col).over(beats), F.stddev_samp("_d").over(pairs)
        sd1 = dd / root
        sd2 = F.sqrt(F.greatest(2 * nn * nn - sd1 * sd1, F.lit(0.0)))
    out = staged.select("*", sd1.alias(f"{prefix}sd1"), sd2.alias(f"{prefix}sd2"))
    return out.withColumns({f"{prefix}{c}": F.when(F.col("_i") >= n, F.col(f"{prefix}{c}")) for c in ("sd1", "sd2")}).drop("_d", "_s", "_i")


def csi(sd1: Column, sd2: Column, clamp: bool = True) -> Column:
    return sd2 / (F.greatest(sd1, F.lit(TINY)) if clamp else F.when(sd1 > 0, sd1))


def mod_csi(sd1: Column, sd2: Column, clamp: bool = True) -> Column:
    """Four times SD2 squared over SD1 (the length squared over the width of the point cloud)."""
    return 4 * sd2 * sd2 / (F.greatest(sd1, F.lit(TINY)) if clamp else F.when(sd1 > 0, sd1))


def hr_slope(rr: DataFrame, keys: Keys, order: list[str], col: str = "rr", n: int = 100, out: str = "slope") -> DataFrame:
    """Absolute least-squares slope of heart rate over the running sum of intervals, last n beats; 0 where time stands still."""
    w = series(keys, order)
    staged = rr.select("*", F.sum(col).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("_t"), heart_rate(F.col(col)).alias("_h"), F.row_number().over(w).alias("_i"))
    slope = F.abs(F.regr_slope("_h", "_t").over(w.rowsBetween(1 - n, 0)))
    return staged.withColumn(out, F.when(F.col("_i") >= n, F.coalesce(slope, F.lit(0.0)))).drop("_t", "_h", "_i")


def rolling_slope(df: DataFrame, keys: Keys, order: list[str], y: str, x: str, n: int, step: int = 1, out: str = "slope") -> DataFrame:
    """Signed slope of y on x over n rows, at every `step`-th full window; `centre` is the mean x."""
    w = series(keys, order)
    frame = w.rowsBetween(1 - n, 0)
    staged = df.select("*", F.regr_slope(y, x).over(frame).alias(out), F.avg(x).over(frame).alias("centre"), F.row_number().over(w).alias("_i"))
    return staged.where((F.col("_i") >= n) & ((F.col("_i") - n) % step == 0)).drop("_i")


def slope_inflated(df: DataFrame, keys: Keys, order: list[str], y: str, n: int, out: str = "slope") -> DataFrame:
    """Slope a beat from the sample covariance over the population variance, as one study variant has it."""
    w = series(keys, order)
    frame = w.rowsBetween(1 - n, 0)
    staged = df.withColumn("_i", F.row_number().over(w))
    value = F.abs(F.covar_samp(y, F.col("_i").cast("double")).over(frame) / F.nullif(F.var_pop(F.col("_i").cast("double")).over(frame), F.lit(0.0)))
    return staged.withColumn(out, F.when(F.col("_i") >= n, value)).drop("_i")


def seizure_features(rr: DataFrame, keys: Keys, order: list[str], col: str = "rr", n: int = 100) -> DataFrame:
    """t_s, CSI, filtered ModCSI, slope of heart rate and both products, a row for each beat with n beats behind it."""
    valid = rr.where(F.col(col).isNotNull() & ~F.isnan(col) & (F.abs(F.col(col)) != float("inf")))
    x = time_from_rr(valid, keys, order, col)
    x = median_beats(x, keys, order, col, out="_f")
    x = x.select("*", (F.col(col) * 1000.0).alias("_ms"), (F.col("_f") * 1000.0).alias("_fms"))
    x = poincare(x, keys, order, "_ms", n, "raw_")
    x = poincare(x, keys, order, "_fms", n, "filt_")
    x = hr_slope(x, keys, order, "_f", n, "SlopeHR_abs")
    x = x.where("raw_sd1 is not null")
    x = x.withColumns({"CSI": csi(F.col("raw_sd1"), F.col("raw_sd2")), "ModCSI_filt": mod_csi(F.col("filt_sd1"), F.col("filt_sd2"))})
    x = x.withColumns({"CSI_x_Slope": F.col("CSI") * F.col("SlopeHR_abs"), "ModCSI_x_Slope": F.col("ModCSI_filt") * F.col("SlopeHR_abs")})
    return x.withColumnRenamed("t_beat", "t_s").drop("_f", "_ms", "_fms", "raw_sd1", "raw_sd2", "filt_sd1", "filt_sd2")


def lorenz_features(rr: DataFrame, keys: Keys, order: list[str], col: str = "rr", t: str = "t", n: int = 100) -> DataFrame:
    """The older set: width T and length L (four deviations), CSI and ModCSI as L/T and L squared over T, signed slope on beat times; null where T is 0."""
    x = poincare(rr, keys, order, col, n, "_", "rotated")
    w = series(keys, order)
    x = x.withColumn("tacho_slope", F.regr_slope(col, t).over(w.rowsBetween(1 - n, 0))).where("_sd1 is not null")
    x = x.withColumns({"T": 4 * F.col("_sd1"), "L": 4 * F.col("_sd2")})
    width = F.when(F.col("T") > 0, F.col("T"))
    return x.withColumns({"CSI": F.col("L") / width, "ModCSI": F.col("L") * F.col("L") / width}).drop("_sd1", "_sd2")


def moving_sum_mean(df: DataFrame, keys: Keys, order: list[str], col: str, n: int, out: str) -> DataFrame:
    """Centred moving mean whose frame is padded with zeros at the ends."""
    half = n // 2
    return df.withColumn(out, F.sum(col).over(series(keys, order).rowsBetween(-half, n - 1 - half)) / float(n))


def rolling_rms(df: DataFrame, keys: Keys, order: list[str], col: str, n: int) -> DataFrame:
    """Moving root mean square (zero-padded), its z-score over the recording, and the moving mean."""
    x = moving_sum_mean(df.withColumn("_sq", F.col(col) * F.col(col)), keys, order, "_sq", n, "_ms")
    x = moving_sum_mean(x, keys, order, col, n, "rolling_mean").withColumn("rolling_rms", F.sqrt("_ms")).drop("_sq", "_ms")
    return zscore(x, keys, "rolling_rms", "rms_z")


def zscore(df: DataFrame, keys: Keys, col: str, out: str) -> DataFrame:
    whole = W.partitionBy(*keys)
    sd = F.stddev_pop(col).over(whole)
    return df.withColumn(out, (F.col(col) - F.avg(col).over(whole)) / F.when(sd > 0, sd))


def rr_irregularity(rr: DataFrame, keys: Keys, order: list[str], col: str = "rr", half: int = 5, z: float = 2.5) -> DataFrame:
    """Share of beats whose residual to the local median is beyond z robust deviations (1.4826 times the median absolute one)."""
    x = median_beats(rr, keys, order, col, 2 * half + 1, "shrink", "_local").withColumn("_r", F.col(col) - F.col("_local"))
    mid = x.groupBy(*keys).agg(F.median("_r").alias("_m"))
    x = x.join(mid, keys).withColumn("_a", F.abs(F.col("_r") - F.col("_m")))
    mad = x.groupBy(*keys).agg((1.4826 * F.median("_a")).alias("_mad"))
    return x.join(mad, keys).groupBy(*keys).agg(F.avg((F.col("_a") / F.greatest("_mad", F.lit(TINY)) > z).cast("int")).alias("irregular"))


def hrv_summary(rr: DataFrame, keys: Keys, order: list[str], col: str = "rr_ms", least: int = 2) -> DataFrame:
    """MeanNN, SDNN, RMSSD, SDSD, pNN50, SD1, SD2 and their ratio of each group with enough beats."""
    x = rr.withColumn("_d", F.col(col) - F.lag(col).over(series(keys, order)))
    g = x.groupBy(*keys).agg(
        F.count("*").alias("n_rr"), F.avg(col).alias("mean_nn"), F.stddev_samp(col).alias("sdnn"),
        F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmssd"), F.stddev_samp("_d").alias("sdsd"),
        F.avg((F.abs("_d") > 50).cast("int")).alias("pnn50"),
    ).where(F.col("n_rr") >= least)
    g = g.withColumn("sd1", F.col("sdsd") / F.sqrt(F.lit(2.0)))
    g = g.withColumn("sd2", F.sqrt(F.greatest(2 * F.col("sdnn") * F.col("sdnn") - F.col("sd1") * F.col("sd1"), F.lit(0.0))))
    return g.withColumn("sd_ratio", F.col("sd2") / F.when(F.col("sd1") > 0, F.col("sd1")))


def local_rr_outlier(rr: DataFrame, keys: Keys, order: list[str], col: str = "rr", width: int = 11, tol: float = 0.12) -> DataFrame:
    """Marks intervals further than `tol` of the local median from it."""
    x = median_beats(rr, keys, order, col, width, "shrink", "_local")
    return x.withColumn("rr_ok", F.abs(F.col(col) - F.col("_local")) <= tol * F.col("_local")).drop("_local")


def stride(df: DataFrame, keys: Keys, order: list[str], n: int, step: int) -> DataFrame:
    """Every `step`-th of the rows that close a full window of n."""
    x = df.withColumn("_i", F.row_number().over(series(keys, order)))
    return x.where((F.col("_i") >= n) & ((F.col("_i") - n) % step == 0)).drop("_i")

"""Audits of annotations and matches, comparisons of feature definitions, and beats summed up by window or segment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beatlake.functions.scalars import correlation, finite
from beatlake.operators.intervals import overlap_pairs
from beatlake.operators.ranges import NUMBER, deviation, range_sums, squared

Keys = list[str]


def short_annotations(events: DataFrame, start: str, end: str, least: float = 10.0) -> DataFrame:
    """Annotations shorter than `least` seconds, or that end before they start."""
    return events.withColumn("duration_s", F.col(end) - F.col(start)).where(F.col("duration_s") < least)


def audit_candidates(metrics: DataFrame, f1: float = 0.995, mismatches: int = 200, p95_ms: float = 20.0) -> DataFrame:
    """Recordings worth a look: a low F1, many mismatches, or late matches; the worst first."""
    x = metrics.withColumn("mismatches", F.col("fn") + F.col("fp"))
    bad = (F.col("f1") < f1) | (F.col("mismatches") > mismatches) | (F.col("p95_abs_dt_ms") > p95_ms)
    return x.where(F.coalesce(bad, F.lit(True))).orderBy("f1", F.desc("mismatches"), F.desc("p95_abs_dt_ms"))


def with_any_value(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows where not all of the columns are null."""
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in cols]))


def valid_peri(windows: DataFrame, role: str, seconds: Column, ictal: float = 5.0, other: float = 55.0) -> DataFrame:
    """Windows long enough for their role."""
    return windows.where(F.when(F.col(role) == "ictal", seconds >= ictal).otherwise(seconds >= other))


def time_windows(beats: DataFrame, keys: Keys, t: str, x: str, length: float = 60.0, step: float = 30.0, block: float | None = None) -> DataFrame:
    """Sliding windows in time from the first beat: count, mean, coefficient of variation of the values in them.

    From prefix sums (`ranges`): a beat is one row, however many windows hold it.
    """
    span = beats.groupBy(*keys).agg(F.min(t).alias("_t0"), F.max(t).alias("_t1"))
    windows = span.withColumn("window_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_t1") - F.col("_t0")) / step).cast("bigint"))))
    windows = windows.withColumns({"_a": F.col("_t0") + F.col("window_idx") * step, "_b": F.col("_t0") + F.col("window_idx") * step + length})
    known = F.col(x).isNotNull().cast("bigint")
    g = range_sums(beats, windows, keys, ["window_idx"], t, ("_a", "_b"), {"_k": known, "_s": F.col(x).cast(NUMBER), "_q": squared(F.col(x))}, block).where("n > 0")
    mean = F.col("_s").cast("double") / F.nullif(F.col("_k"), F.lit(0))
    return g.select(*keys, "window_idx", "n", mean.alias("mean"), (deviation(F.col("_k"), F.col("_s"), F.col("_q")) / F.nullif(mean, F.lit(0.0))).alias("cv"))


def by_segment(points: DataFrame, segments: DataFrame, keys: Keys, idx: list[str], t: str, x: str, s: tuple[str, str], least: int = 3) -> DataFrame:
    """Median and mean of the finite values in each segment (start included, end not); null for fewer than `least`."""
    p = points.where(finite(F.col(x))).select(*keys, F.col(t).alias("_t"), F.col(t).alias("_u"), F.col(x).alias("_x"))
    pairs = overlap_pairs(segments, p, keys, s, ("_t", "_u"), closed=True).where(F.col("_t") < F.col(s[1]))
    g = pairs.groupBy(*keys, *idx).agg(F.count("*").alias("n"), F.median("_x").alias("_m"), F.avg("_x").alias("_a"))
    enough = F.col("n") >= least
    return segments.join(g, [*keys, *idx], "left").select(*keys, *idx, F.coalesce("n", F.lit(0)).alias("n"), F.when(enough, F.col("_m")).alias("median"), F.when(enough, F.col("_a")).alias("mean"))


def painted(points: DataFrame, windows: DataFrame, keys: Keys, t: str, w: tuple[str, str], score: str, how: str = "mean") -> DataFrame:
    """Each point with the mean, largest or last-starting score of the windows over it."""
    p = points.select(*keys, t).distinct()
    pairs = overlap_pairs(p.withColumn("_u", F.col(t)), windows.select(*keys, *w, score), keys, (t, "_u"), w, closed=True).where(F.col(t) < F.col(w[1]))
    agg = {"mean": F.avg(score), "max": F.max(score), "last": F.max_by(score, w[0])}[how]
    return points.join(pairs.groupBy(*keys, t).agg(agg.alias(score)), [*keys, t], "left")


def compare_definitions(df: DataFrame, keys: Keys, a: str, b: str) -> DataFrame:
    """Correlation, median and 99th percentile of the absolute difference, and the difference of the 99th percentiles."""
    d = F.abs(F.col(a) - F.col(b))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), correlation(a, b).alias("corr"), F.median(d).alias("median_abs_diff"), F.percentile(d, F.lit(0.99)).alias("p99_abs_diff"), (F.percentile(a, F.lit(0.99)) - F.percentile(b, F.lit(0.99))).alias("p99_shift"))


def match_rate(pairs: DataFrame, ref: DataFrame, keys: Keys) -> DataFrame:
    """Share of the reference events that have a match."""
    n = ref.groupBy(*keys).agg(F.count("*").alias("_n"))
    hit = pairs.select(*keys, "t_ref").distinct().groupBy(*keys).agg(F.count("*").alias("_h"))
    return n.join(hit, keys, "left").select(*keys, (F.coalesce("_h", F.lit(0)) / F.col("_n")).alias("match_rate"))


def beat_correlation(beats: DataFrame, keys: Keys, beat: str, col: str = "samples") -> DataFrame:
    """Each beat's correlation with the mean beat of its recording, by aggregation over positions."""
    long = beats.select(*keys, beat, F.posexplode(col).alias("_i", "_x"))
    mean = long.groupBy(*keys, "_i").agg(F.avg("_x").alias("_m"))
    both = long.join(mean, [*keys, "_i"])
    return both.groupBy(*keys, beat).agg(correlation("_x", "_m").alias("template_corr"))


def beat_sqi(corrs: DataFrame, keys: Keys, good: float = 0.5) -> DataFrame:
    """Mean template correlation and the share of beats that look like it."""
    return corrs.groupBy(*keys).agg(F.avg("template_corr").alias("mean_corr"), F.avg((F.col("template_corr") >= good).cast("int")).alias("share_good"))


def rr_consistency(rr: DataFrame, keys: Keys, order: list[str], col: str = "rr", most: float = 0.2) -> DataFrame:
    """Share of intervals within `most` of the one before."""
    w = W.partitionBy(*keys).orderBy(*order)
    x = rr.withColumn("_p", F.lag(col).over(w)).where("_p is not null")
    return x.groupBy(*keys).agg(F.avg((F.abs(F.col(col) - F.col("_p")) <= most * F.col("_p")).cast("int")).alias("consistency"))


def noise_index(lf_share: Column, hf_share: Column) -> Column:
    return F.least(F.lit(1.0), 5 * lf_share + 20 * hf_share)


def mse_offset(a: DataFrame, b: DataFrame, keys: Keys, i: str, x: str, offsets: list[int]) -> DataFrame:
    """The shift of b with the smallest mean squared difference from a; the first of equals.

    Both sides meet in blocks as long as the range of shifts, so a pair of samples is made once, for the one shift that it stands for.
    """
    place = F.array_position(F.array(*(F.lit(int(o)) for o in offsets)), (F.col("_i") - F.col("_j")).cast("int")) - 1
    first, span = min(offsets), max(offsets) - min(offsets) + 1
    p = a.select(*keys, F.col(i).alias("_i"), F.col(x).alias("_x")).withColumn("_k", F.floor((F.col("_i") - first) / span))
    q = b.select(*keys, F.col(i).alias("_j"), F.col(x).alias("_y")).withColumn("_k", F.explode(F.array(*(F.floor(F.col("_j") / span) + d for d in (0, 1)))))
    near = p.join(q, [*keys, "_k"]).withColumn("rank", place).where("rank >= 0")
    g = near.groupBy(*keys, "rank", (F.col("_i") - F.col("_j")).alias("offset")).agg(F.avg((F.col("_x") - F.col("_y")) ** 2).alias("mse"))
    best = g.groupBy(*keys).agg(F.min(F.struct(F.round("mse", 9).alias("m"), "rank", "offset")).alias("b"))
    return best.select(*keys, F.col("b.offset").cast("int").alias("offset"), F.col("b.m").alias("mse"))


def spectral_peaks(spectrum: DataFrame, keys: Keys, bin_: str, power: str, n: int = 5) -> DataFrame:
    """The n strongest local maxima of a spectrum, best first: a noise fingerprint."""
    w = W.partitionBy(*keys).orderBy(bin_)
    p = F.col(power)
    top = spectrum.withColumn("_top", (p > F.coalesce(F.lag(power).over(w), F.lit(-1.0))) & (p >= F.coalesce(F.lead(power).over(w), F.lit(-1.0)))).where("_top").drop("_top")
    return top.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(power), bin_))).where(F.col("rank") <= n)


def modulation(frames: DataFrame, keys: Keys, t: str, magnitude: str) -> DataFrame:
    """For each frequency bin, how its magnitude varies over frames: mean, deviation, and their ratio (the depth of modulation)."""
    long = frames.select(*keys, t, F.posexplode(magnitude).alias("bin", "_m"))
    g = long.groupBy(*keys, "bin").agg(F.avg("_m").alias("mean"), F.stddev_pop("_m").alias("std"))
    return g.withColumn("depth", F.col("std") / F.nullif(F.col("mean"), F.lit(0.0)))

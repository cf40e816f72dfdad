"""Detection thresholds by patient, recording or population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beatlake.functions.scalars import finite
from beatlake.operators.quantiles import quantiles

Keys = list[str]


def quantile_threshold(df: DataFrame, keys: Keys, value: str, q: float, where: Column | None = None, out: str = "threshold") -> DataFrame:
    """A quantile of finite values by key (or of all, without keys)."""
    ok = finite(F.col(value)) if where is None else finite(F.col(value)) & where
    return quantiles(df.where(ok), keys, {out: (value, q)}, every=False)


def baseline_first_threshold(df: DataFrame, keys: Keys, order: list[str], value: str, q: float, beats: int, width: int, out: str = "threshold") -> DataFrame:
    """A quantile of the first `beats` rows where that is more than a window, else of all."""
    x = df.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return quantile_threshold(x, keys, value, q, F.col("_i") <= beats if beats > width else None, out)


def segment_thresholds(
    df: DataFrame, events: DataFrame, patient: str, recording: str, t: str, value: str, e: tuple[str, str], segments: dict[str, float | None], factor: float = 1.05, first: bool = True, fallback: DataFrame | None = None
) -> DataFrame:
    """patient, threshold, mode, recording: `factor` times the largest value of the first seizure-free segment.

    Segments start at 0 and end after that many seconds (None: half of the
    recording's span), in order of preference. With `first` only a patient's
    first recording counts, else the largest of all. Patients without a
    seizure-free segment get `fallback` (patient, threshold), else `factor`
    times their largest value.
    """
    x = df.where(finite(F.col(value)))
    span = x.groupBy(patient, recording).agg(F.max(t).alias("_end"))
    if first:
        span = span.withColumn("_rn", F.row_number().over(W.partitionBy(patient).orderBy(recording))).where("_rn = 1").drop("_rn")
    spine = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(name).alias("mode"), F.lit(None if s is None else float(s)).cast("double").alias("s")) for i, (name, s) in enumerate(segments.items())))
    seg = span.withColumn("_g", F.explode(spine)).select(patient, recording, "_g.rank", "_g.mode", F.coalesce("_g.s", F.col("_end") / 2).alias("_s1"))
    clash = seg.join(events.select(recording, F.col(e[0]).alias("_e0"), F.col(e[1]).alias("_e1")), recording).where((F.col("_e0") < F.col("_s1")) & (F.col("_e1") > 0)).select(recording, "rank").distinct()
    free = seg.join(clash, [recording, "rank"], "left_anti")
    top = x.select(recording, F.col(t).alias("_t"), F.col(value).alias("_v")).join(free, recording).where((F.col("_t") >= 0) & (F.col("_t") < F.col("_s1")))
    top = top.groupBy(patient, recording, "rank", "mode").agg(F.max("_v").alias("_m"))
    if first:
        best = top.groupBy(patient).agg(F.min(F.struct("rank", "mode", F.col("_m"), F.col(recording).alias("rec"))).alias("b"))
    else:
        best = top.groupBy(patient).agg(F.max(F.struct("_m", (-F.col("rank")).alias("rank"), "mode", F.col(recording).alias("rec"))).alias("b"))
    found = best.select(patient, (F.col("b._m") * factor).alias("threshold"), F.col("b.mode").alias("mode"), F.col("b.rec").alias("thr_recording"))
    whole = x.groupBy(patient).agg((F.max(value) * factor).alias("_g"))
    out = whole.join(found, patient, "left")
    if fallback is not None:
        out = out.join(fallback.select(patient, F.col("threshold").alias("_f")), patient, "left")
    else:
        out = out.withColumn("_f", F.lit(None).cast("double"))
    mode = F.coalesce("mode", F.when(F.col("_f").isNotNull(), "given").otherwise("global_max"))
    return out.select(patient, F.coalesce("threshold", "_f", "_g").alias("threshold"), mode.alias("mode"), "thr_recording")


def early_baseline(df: DataFrame, keys: Keys, t: str, value: str, definitions: dict[str, float], factor: float = 1.05) -> DataFrame:
    """For each definition of the early baseline (its seconds) and key, `factor` times the largest value in it."""
    spine = F.array(*(F.struct(F.lit(n).alias("definition"), F.lit(float(s)).alias("s")) for n, s in definitions.items()))
    x = df.where(finite(F.col(value))).withColumn("_d", F.explode(spine)).where(F.col(t) < F.col("_d.s"))
    return x.groupBy(*keys, F.col("_d.definition").alias("definition")).agg((F.max(value) * factor).alias("threshold"))


def attach(df: DataFrame, thresholds: DataFrame, key: str, take: str = "threshold", out: str = "threshold") -> DataFrame:
    """A lookup of one value by key; null without one."""
    return df.join(thresholds.select(key, F.col(take).alias(out)), key, "left")

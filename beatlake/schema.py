"""Table schemas of the engine and guards on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RECORDINGS = """recording_uid bigint, patient_id bigint, enrollment_id string, recording_id bigint, tdms_path string, annotation_source string,
recording_start timestamp_ntz, recording_end timestamp_ntz, rec_duration_s double, fs double, trim_start_s double, trim_end_s double"""
EVENTS = """recording_uid bigint, patient_id bigint, enrollment_id string, recording_id bigint, seizure_id bigint, t0 double, t1 double, duration_s double,
absolute_start timestamp_ntz, absolute_end timestamp_ntz, trim_start_s double, trim_end_s double, t0_trim double, t1_trim double"""
WINDOWS = """recording_uid bigint, patient_id bigint, recording_id bigint, window_idx bigint, win_start_s double, win_end_s double, context string,
std double, range double, diff_abs_med double, is_flatline boolean, is_noiseburst boolean, is_clipping boolean"""
SIGNAL = "recording_uid bigint, chunk_idx bigint, start_sample bigint, fs double, samples array<double>"
RR_PAIR = "RR_labview_s double, RR_python_s double"
TRIM = "recording_uid bigint, patient_id bigint, recording_id bigint, trim_start_s double, trim_end_s double, duration_s double"


def require_columns(df: DataFrame, *need: str) -> DataFrame:
    """`df`, or KeyError naming what is missing."""
    if missing := sorted(set(need) - set(df.columns)):
        raise KeyError(f"missing columns: {missing}")
    return df


def pick_column(df: DataFrame, *candidates: str, contains: tuple[str, ...] = ()) -> str:
    """The first candidate that `df` has, else the first column whose name holds one of `contains`."""
    for c in candidates:
        if c in df.columns:
            return c
    for token in contains:
        for c in df.columns:
            if token in c.lower():
                return c
    raise KeyError(f"none of {candidates} in {df.columns}")


def coerce_keys(df: DataFrame, *keys: str, kind: str = "bigint") -> DataFrame:
    """Keys cast to numbers; rows where that fails go."""
    for k in keys:
        df = df.withColumn(k, F.col(k).try_cast(kind))
    return df.na.drop(subset=list(keys))


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """`df`, failing at run time where a key occurs twice (the right side of an m:1 join)."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    guard = F.when(n > 1, F.raise_error(F.concat_ws(" ", F.lit("duplicate key:"), *(F.col(k).cast("string") for k in keys)))).otherwise(F.lit(True))
    return df.withColumn("_unique", guard.cast("boolean")).where("_unique").drop("_unique")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dedup_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in an explicit order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")

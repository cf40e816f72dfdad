"""Sinks: tables by recording, caches keyed by what made them, small LaTeX tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = (), form: str = "parquet") -> None:
    """Parquet, CSV (with header) or JSON, in folders by key where given, so later reads prune."""
    w = df.write.mode("overwrite")
    w = w.partitionBy(*by) if by else w
    if form == "csv":
        w.option("header", True).csv(path)
    elif form == "json":
        w.json(path)
    else:
        w.parquet(path)


def to_latex(df: DataFrame, most: int = 200, digits: int = 2) -> str:
    """A small table (an error above `most` rows) as a LaTeX tabular."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("_", r"\_")
    lines = [" & ".join(c.replace("_", r"\_") for c in df.columns), *(" & ".join(map(cell, r)) for r in rows)]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", r" \\".join([*lines, ""]).rstrip(), r"\end{tabular}"])


PEAK_KEYS = ["recording_uid", "algo_id", "fs", "crop_start_s", "crop_end_s"]
PEAK_DDL = "recording_uid bigint, algo_id string, fs double, crop_start_s double, crop_end_s double"


def cache_key() -> Column:
    """A name of what made some peaks: the folder that holds them."""
    return F.md5(F.to_json(F.struct(*PEAK_KEYS), {"ignoreNullFields": "false"}))


def cached_keys(spark: SparkSession, cache: str) -> DataFrame | None:
    """What the cache table holds, recordings without any peak among them; None for an absent cache."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(PEAK_DDL).parquet(cache).distinct()


def missing_from_cache(spark: SparkSession, wanted: DataFrame, cache: str) -> DataFrame:
    """The (recording, method, rate, crop) rows of `wanted` that the cache table doesn't hold; an absent cache holds none."""
    held = cached_keys(spark, cache)
    if held is None:
        return wanted
    a, b = wanted.alias("a"), held.alias("b")
    return a.join(b, reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in PEAK_KEYS)), "left_anti")


def append_to_cache(peaks: DataFrame, cache: str, made: DataFrame | None = None) -> None:
    """Writes the peaks of some recordings; again, it writes the same.

    Each (recording, method, rate, crop) has a folder of its own, which is
    replaced whole when the job commits: a repeated job leaves no row twice,
    and one that failed left what was there. `made` names all that was worked
    on, so recordings without a peak count as done too (a row with nulls,
    which `read_cache` leaves out).
    """
    rows = peaks
    if made is not None:
        a, b = made.select(*PEAK_KEYS).distinct().alias("a"), peaks.select(*PEAK_KEYS).distinct().alias("b")
        none = a.join(b, reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in PEAK_KEYS)), "left_anti")
        rows = peaks.unionByName(none, allowMissingColumns=True)
    rows = rows.withColumn("cache_key", cache_key())
    # a folder's rows in few files, a recording with very many in several
    rows = rows.hint("rebalance", "cache_key")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cache_key").parquet(cache)


def read_cache(spark: SparkSession, cache: str, wanted: DataFrame | None = None) -> DataFrame:
    """All peaks of the cache, or those of some recordings: only their folders are read."""
    rows = spark.read.parquet(cache)
    if wanted is not None:
        rows = rows.join(wanted.select(cache_key().alias("cache_key")).distinct(), "cache_key", "left_semi")
    own = [c for c in rows.columns if c not in PEAK_KEYS and c != "cache_key"]
    return rows.where(reduce(lambda x, y: x | y, (F.col(c).isNotNull() for c in own))).drop("cache_key") if own else rows.drop("cache_key")


def export_segments(slices: DataFrame, path: str, fs: float) -> None:
    """Event and other slices as Parquet by kind, each with its length and range for review."""
    x = slices.withColumns({"n_samples": F.size("samples"), "seconds": F.size("samples") / fs, "range": F.array_max("samples") - F.array_min("samples")})
    x.write.mode("overwrite").partitionBy("kind").parquet(path)

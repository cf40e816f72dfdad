"""Events from thresholds: islands, merges, refractory times, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beatlake.operators import scan

Keys = list[str]


def island_ids(rows: DataFrame, keys: Keys, order: list[str], t: str, gap: float, out: str = "island", block: float | None = None) -> DataFrame:
    """Numbers islands of rows no further apart than `gap` (a larger gap splits); with a `block` of time, a recording is dealt over tasks (`scan`)."""
    return scan.groups_apart(rows, keys, order, t, gap, block, out)


def event_list(rows: DataFrame, keys: Keys, order: list[str], t: str, value: str, threshold: Column | float, gap: float = 60.0, inclusive: bool = False, block: float | None = None) -> DataFrame:
    """Events of values above the threshold: start, end, duration, first time of the peak, peak, count."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    over = rows.where((F.col(value) >= limit) if inclusive else (F.col(value) > limit))
    x = island_ids(over, keys, order, t, gap, block=block)
    # the largest value, the earliest time among equals
    peak = F.max(F.struct(F.col(value), (-F.col(t)).alias("back")))
    g = x.groupBy(*keys, "island").agg(F.min(t).alias("t_start"), F.max(t).alias("t_end"), peak.alias("_p"), F.count("*").alias("n_points"))
    return g.select(*keys, "t_start", "t_end", (F.col("t_end") - F.col("t_start")).alias("duration_s"), (-F.col("_p.back")).alias("t_peak"), F.col(f"_p.{value}").alias("peak_value"), "n_points")


def ordinal_events(rows: DataFrame, keys: Keys, order: list[str], t: str, on: Column, merge: int = 50) -> DataFrame:
    """Runs of rows where `on` holds, joined where at most `merge` others lie between."""
    w = W.partitionBy(*keys).orderBy(t, *order)
    x = rows.withColumn("ord", F.row_number().over(w)).where(on)
    new = F.when(F.col("ord") - F.lag("ord").over(w) - 1 > merge, 1).otherwise(0)
    x = x.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy(*keys, "run").agg(F.min(t).alias("t_start"), F.max(t).alias("t_end"), F.min("ord").alias("ord_start"), F.max("ord").alias("ord_end"), F.count("*").alias("n_points"))


def merge_overlaps(events: DataFrame, keys: Keys, start: str = "t_start", end: str = "t_end", block: float | None = None) -> DataFrame:
    """The union of intervals: those that overlap or touch become one. With a `block` of time a recording is dealt over tasks (`scan`)."""
    order = [start, end]
    reach = F.max(end).over(scan.within(keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    x = scan.blocked(events, start, block)
    x = scan.carried(x, keys, [F.max(end).alias("_hi")], lambda s: s.withColumn("_far", F.max("_hi").over(scan.earlier(keys))), block, ["_far"])
    x = x.withColumn("_new", F.when(F.col(start) <= F.greatest(reach, F.col("_far")), 0).otherwise(1))
    x = scan.running_sums(x, keys, order, {"_m": F.col("_new")}, block)
    return x.groupBy(*keys, "_m").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("_m")


def refractory(rows: DataFrame, keys: Keys, t: str, hold: float, block: float | None = None) -> DataFrame:
    """Times that are at least `hold` after the last one kept: a pass over sorted times that carries the last one alone; with a `block` of time, a recording is dealt over tasks (`scan`)."""
    if hold <= 0:
        return rows.select(*keys, F.col(t).cast("double").alias(t)).where(F.col(t).isNotNull())
    return scan.kept_apart(rows, keys, t, hold, block)


def refractory_events(rows: DataFrame, keys: Keys, order: list[str], t: str, value: str, threshold: Column | float, gap: float, min_duration: float, hold: float, block: float | None = None) -> DataFrame:
    """Islands of some duration whose peaks keep the refractory time."""
    found = event_list(rows, keys, order, t, value, threshold, gap, block=block).where(F.col("duration_s") >= min_duration)
    return found.join(refractory(found.select(*keys, "t_peak"), keys, "t_peak", hold, block).distinct(), [*keys, "t_peak"], "left_semi")


def long_runs(rows: DataFrame, keys: Keys, order: list[str], t: str, on: Column, least: float) -> DataFrame:
    """Runs of successive rows where `on` holds whose steps in time sum up to `least` or more."""
    w = W.partitionBy(*keys).orderBy(t, *order)
    x = rows.withColumn("_on", on).withColumn("_dt", F.coalesce(F.col(t) - F.lag(t).over(w), F.lit(0.0)))
    x = x.withColumn("_c", F.when(F.col("_on") == F.coalesce(F.lag("_on").over(w), ~F.col("_on")), 0).otherwise(1))
    x = x.withColumn("run", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = x.where("_on").groupBy(*keys, "run").agg(F.min(t).alias("t_start"), F.max(t).alias("t_end"), F.sum("_dt").alias("run_s"), F.count("*").alias("n_points"))
    return g.where(F.col("run_s") >= least).drop("run")


def index_runs(rows: DataFrame, keys: Keys, idx: str) -> DataFrame:
    """Runs of consecutive indices: first, last, length."""
    w = W.partitionBy(*keys).orderBy(idx)
    x = rows.withColumn("_g", F.col(idx) - F.row_number().over(w))
    return x.groupBy(*keys, "_g").agg(F.min(idx).alias("first_idx"), F.max(idx).alias("last_idx"), F.count("*").alias("n")).drop("_g")


def trim_points(windows: DataFrame, keys: Keys, idx: str, bad: Column, k: int, edge: int) -> DataFrame:
    """First and last window of runs of at least k clean windows that start (end) within `edge` windows of the ends; null without one."""
    ends = windows.groupBy(*keys).agg(F.min(idx).alias("_lo"), F.max(idx).alias("_hi"))
    runs = index_runs(windows.where(~bad), keys, idx).where(F.col("n") >= k)
    x = ends.join(runs, keys, "left")
    first = F.min(F.when(F.col("first_idx") <= F.col("_lo") + edge, F.col("first_idx")))
    last = F.max(F.when(F.col("last_idx") >= F.col("_hi") - edge, F.col("last_idx")))
    return x.groupBy(*keys).agg(first.alias("trim_first"), last.alias("trim_last"))


def inter_event_intervals(events: DataFrame, keys: Keys, start: str, end: str | None = None) -> DataFrame:
    """Time since the event before (its start, or its end where given); the first of a recording has none."""
    w = W.partitionBy(*keys).orderBy(start)
    return events.withColumn("isi_s", F.col(start) - F.lag(end or start).over(w)).where("isi_s is not null")


def interval_summary(isi: DataFrame, keys: Keys, col: str = "isi_s") -> DataFrame:
    q = F.percentile(col, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = isi.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(col).alias("mean"), F.min(col).alias("min"), F.max(col).alias("max"), q.alias("_q"))
    return g.select(*keys, "n", "mean", "min", "max", F.col("_q")[1].alias("median"), (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"))


def local_peaks(rows: DataFrame, keys: Keys, order: list[str], t: str, value: str, threshold: float, hold: float) -> DataFrame:
    """Local maxima above a threshold that keep a refractory time."""
    w = W.partitionBy(*keys).orderBy(t, *order)
    v = F.col(value)
    x = rows.withColumn("_top", (v > threshold) & (v > F.lag(value).over(w)) & (v >= F.lead(value).over(w)))
    return refractory(x.where("_top"), keys, t, hold)

"""Scores of detected events against annotated ones: recall and false alarms an hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beatlake.operators import scan
from beatlake.operators.intervals import overlap_pairs

Keys = list[str]


def analyzable_hours(windows: DataFrame, keys: Keys, w: tuple[str, str], accept: Column | None = None, by: Keys = ()) -> DataFrame:
    """Hours of distinct windows (accepted ones), by some of the keys or in all."""
    x = windows if accept is None else windows.where(accept)
    one = x.select(*dict.fromkeys([*by, *keys]), *w).distinct()
    return one.groupBy(*by).agg((F.sum(F.greatest(F.col(w[1]) - F.col(w[0]), F.lit(0.0))) / 3600.0).alias("hours"))


def touched(found: DataFrame, truth: DataFrame, keys: Keys, f: tuple[str, str], e: tuple[str, str], pad: float = 0.0, block: float | None = None) -> DataFrame:
    """Distinct found (`_side` 0) and annotated events (1) of a recording, and whether any of the other side, annotated ones widened by `pad`, overlaps or touches them (`_hit`).

    An interval is overlapped where the latest end of those that start up to
    its end isn't before its start. Both sides' starts and ends, in order of
    time, give that by two running maxima: two rows an interval, no pairs.
    With a `block` of time a recording is dealt over tasks (`scan`).
    """
    one = lambda df, s, side, wide: df.select(*keys, *s).distinct().select(*keys, F.lit(side).alias("_side"), (F.col(s[0]).cast("double") - wide).alias("_a"), (F.col(s[1]).cast("double") + wide).alias("_b"))
    both = one(found, f, 0, 0.0).unionByName(one(truth, e, 1, float(pad)))
    ends = F.array(F.struct(F.lit(0).alias("_end"), F.col("_a").alias("_at")), F.struct(F.lit(1).alias("_end"), F.col("_b").alias("_at")))
    x = scan.blocked(both.select("*", F.explode(ends).alias("_p")).select(*keys, "_side", "_a", "_b", "_p.*"), "_at", block)
    reach = lambda side: F.max(F.when((F.col("_side") == side) & (F.col("_end") == 0) & F.col("_a").isNotNull(), F.col("_b")))
    before = lambda s: s.withColumns({f"_far{side}": F.max(f"_hi{side}").over(scan.earlier(keys)) for side in (0, 1)})
    x = scan.carried(x, keys, [reach(side).alias(f"_hi{side}") for side in (0, 1)], before, block, ["_far0", "_far1"])
    w = scan.within(keys).orderBy("_at", "_end").rowsBetween(W.unboundedPreceding, 0)
    latest = F.when(F.col("_side") == 0, F.greatest(reach(1).over(w), "_far1")).otherwise(F.greatest(reach(0).over(w), "_far0"))
    return x.withColumn("_hit", F.coalesce(latest >= F.col("_a"), F.lit(False))).where("_end = 1").select(*keys, "_side", "_a", "_b", "_hit")


def score(found: DataFrame, truth: DataFrame, recording: str, f: tuple[str, str], e: tuple[str, str], pad: float, hours: DataFrame, by: Keys = (), overall: str | None = None, block: float | None = None) -> DataFrame:
    """By group: events, those that no annotated event (widened by `pad`) overlaps, annotated events found, recall, false alarms an hour.

    `truth` has the group columns too: which annotated events count for a
    group. One plan scores all groups; nothing is looped over. `overall` is a
    group column that follows from the recording: its groups are also summed
    up as `all`, without scoring their events again.
    """
    by = list(by)
    n = lambda side, hit=F.lit(True): F.count(F.when((F.col("_side") == side) & hit, 1))
    x = touched(found, truth, [*by, recording], f, e, pad, block).groupBy(*by).agg(n(0).alias("n_events"), n(1).alias("n_true"), n(1, F.col("_hit")).alias("n_detected"), n(0, ~F.col("_hit")).alias("n_false"))
    if overall:
        x = with_overall(x, overall).groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n_events", "n_true", "n_detected", "n_false")))
    if any(b in hours.columns for b in by):
        x = x.join(hours, [b for b in by if b in hours.columns], "left")
    else:
        x = x.withColumn("hours", F.lit(hours.first()["hours"]))
    return x.withColumns({"recall": F.col("n_detected") / F.nullif(F.col("n_true"), F.lit(0)), "far_per_h": F.col("n_false") / F.nullif(F.col("hours"), F.lit(0.0))})


def with_sqi_modes(df: DataFrame, accept: str, modes: dict[str, str | None], out: str = "sqi") -> DataFrame:
    """Rows for each mode: all of them (None), or those where the mode's column holds or is missing.

    Rows outside every window have no verdict and stay, as in the study.
    """
    each = [F.when(F.lit(True) if c is None else F.coalesce(F.col(c or accept), F.lit(True)), F.lit(m)) for m, c in modes.items()]
    return df.withColumn(out, F.explode(F.filter(F.array(*each), lambda m: m.isNotNull())))


def with_overall(df: DataFrame, col: str, overall: str = "all") -> DataFrame:
    """Each row twice: in its own group and in the overall one (the shape of grouping sets)."""
    return df.withColumn(col, F.explode(F.array(F.col(col).cast("string"), F.lit(overall))))


def responders(df: DataFrame, patient: str, ids: list[int], out: str = "is_responder") -> DataFrame:
    return df.withColumn(out, F.col(patient).isin(*ids) if ids else F.lit(False))


def over_threshold(df: DataFrame, keys: Keys, value: str, threshold: str) -> DataFrame:
    hit = (F.col(value) > F.col(threshold)).cast("int")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(hit).alias("share_over"), F.sum(hit).alias("n_over"))


def peak_scores(found: DataFrame, truth: DataFrame, keys: Keys, peak: str, e: tuple[str, str], margin: float) -> DataFrame:
    """By recording: events whose peak lies within `margin` of an annotated event (true), others (false)."""
    wide = truth.select(*keys, (F.col(e[0]) - margin).alias("_t0"), (F.col(e[1]) + margin).alias("_t1"))
    x = found.withColumn("_p", F.col(peak))
    hit = overlap_pairs(x.select(*keys, peak, "_p").distinct(), wide, keys, (peak, "_p"), ("_t0", "_t1"), closed=True).select(*keys, peak).distinct().withColumn("_hit", F.lit(1))
    y = found.join(hit, [*keys, peak], "left")
    return y.groupBy(*keys).agg(F.count("_hit").alias("n_true"), (F.count("*") - F.count("_hit")).alias("n_false"))

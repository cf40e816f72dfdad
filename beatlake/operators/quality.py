"""Signal-quality windows, recording quality, rule classifiers, and retention tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beatlake.functions.scalars import TINY, finite
from beatlake.operators.intervals import overlap_pairs
from beatlake.operators.quantiles import quantiles, with_quantiles

Keys = list[str]


def window_stats(samples: DataFrame, keys: Keys, i: str, x: str, size: int, partial: bool = False) -> DataFrame:
    """Tumbling windows of `size` samples (index from 0): population deviation, range, median absolute difference; a partial tail goes unless asked for.

    Differences are within a window.
    """
    s = samples.withColumn("window_idx", F.floor(F.col(i) / size).cast("bigint"))
    s = s.withColumn("_d", F.abs(F.col(x) - F.lag(x).over(W.partitionBy(*keys, "window_idx").orderBy(i))))
    g = s.groupBy(*keys, "window_idx").agg(F.count("*").alias("n"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.median("_d").alias("diff_abs_med"))
    g = g.withColumn("range", F.col("max") - F.col("min"))
    return g if partial else g.where(F.col("n") == size)


def quality_flags(windows: DataFrame, keys: Keys, flat_std: float, noise_factor: float, clip_share: float = 0.9, signal_range: Column | None = None) -> DataFrame:
    """is_flatline, is_noiseburst (against the recording's median deviation), is_clipping (against its range)."""
    whole = W.partitionBy(*keys)
    mid = windows.groupBy(*keys).agg(F.median("std").alias("std_median"))
    x = windows.join(mid, keys)
    span = signal_range if signal_range is not None else F.max("max").over(whole) - F.min("min").over(whole)
    return x.withColumns({
        "is_flatline": F.col("std") < flat_std,
        "is_noiseburst": F.col("std") > noise_factor * F.col("std_median"),
        "is_clipping": F.col("range") > clip_share * span,
    })


def recording_quality(flagged: DataFrame, keys: Keys) -> DataFrame:
    """A row a recording: percentiles of window statistics (a recording's windows are few) and shares of flagged windows."""
    p = lambda c, q: F.percentile(c, F.lit(q))
    share = lambda c: F.avg(F.col(c).cast("int"))
    return flagged.groupBy(*keys).agg(
        F.count("*").alias("n_windows"), p("std", 0.5).alias("win_std_median"), p("std", 0.01).alias("win_std_p01"), p("std", 0.99).alias("win_std_p99"),
        p("range", 0.5).alias("win_range_median"), p("range", 0.99).alias("win_range_p99"), share("is_flatline").alias("frac_flatline"),
        share("is_noiseburst").alias("frac_noiseburst"), share("is_clipping").alias("frac_clipping"), p("diff_abs_med", 0.5).alias("diff_abs_median"),
    )


def acceptable(df: DataFrame, flags: tuple[str, ...] = ("is_flatline", "is_noiseburst", "is_clipping"), out: str = "is_acceptable") -> DataFrame:
    """No flag set; flags that the table lacks, or that are null, count as unset."""
    bad = F.lit(False)
    for f in flags:
        if f in df.columns:
            bad = bad | F.coalesce(F.col(f), F.lit(False))
    return df.withColumn(out, ~bad)


@dataclass(frozen=True)
class Variant:
    """An acceptance rule: flags to heed, and upper limits by column."""

    name: str
    flags: tuple[str, ...] = ()
    limits: dict[str, float] = field(default_factory=dict)


def add_variants(df: DataFrame, variants: list[Variant]) -> DataFrame:
    """A column accept_<name> for each variant."""
    out = {}
    for v in variants:
        ok = F.lit(True)
        for f in v.flags:
            ok = ok & ~F.coalesce(F.col(f), F.lit(False))
        for c, limit in v.limits.items():
            ok = ok & F.coalesce(F.col(c) <= limit, F.lit(False))
        out[f"accept_{v.name}"] = ok
    return df.withColumns(out)


def classify_recordings(q: DataFrame, flat: float = 0.2, noise: float = 0.2, clip: float = 0.05, flat_warn: float = 0.05, noise_warn: float = 0.05, clip_warn: float = 0.01, std_low: float = 1e-6, error: str | None = None) -> DataFrame:
    """quality_label bad, borderline or good by the first rule that applies, with all reasons of that grade.

    Shares are printed as C does it: the double's own value to three places, halves to even.
    """
    err = (F.col(error).isNotNull() & (F.col(error) != "")) if error else F.lit(False)
    say = lambda cond, text, c: F.when(cond, F.concat(F.lit(text), F.format_number(c, 3)))
    bad = F.concat_ws(
        "; ", F.when(err, F.concat(F.lit("load error: "), F.col(error))) if error else F.lit(None).cast("string"),
        say(F.col("frac_flatline") > flat, "flatline share ", "frac_flatline"), say(F.col("frac_noiseburst") > noise, "noise share ", "frac_noiseburst"),
        say(F.col("frac_clipping") > clip, "clipping share ", "frac_clipping"), say(F.col("win_std_median") < std_low, "median deviation ", "win_std_median"),
    )
    warn = F.concat_ws("; ", say(F.col("frac_flatline") > flat_warn, "flatline share ", "frac_flatline"), say(F.col("frac_noiseburst") > noise_warn, "noise share ", "frac_noiseburst"), say(F.col("frac_clipping") > clip_warn, "clipping share ", "frac_clipping"))
    x = q.select("*", bad.alias("_bad"), warn.alias("_warn"))
    label = F.when(F.col("_bad") != "", "bad").when(F.col("_warn") != "", "borderline").otherwise("good")
    return x.withColumns({"quality_label": label, "quality_reason": F.when(F.col("_bad") != "", F.col("_bad")).otherwise(F.col("_warn"))}).drop("_bad", "_warn")


def quality_class(flat: Column, noise: Column, clip: Column) -> Column:
    """Rule ladder Q1 (best) to Q3, QL for recordings mostly lost."""
    worst = F.greatest(flat, noise, clip)
    return F.when(flat > 0.5, "QL").when(worst <= 0.01, "Q1").when(worst <= 0.05, "Q2").otherwise("Q3")


def flat_windows(stats: DataFrame, std: float, span: float) -> DataFrame:
    return stats.where((F.col("std") < std) & (F.col("range") < span))


def weighted_summary(df: DataFrame, keys: Keys, metrics: list[str], weight: str) -> DataFrame:
    """A row for each metric: plain and weighted mean over finite values, median, p10, p90."""
    long = df.select(*keys, F.col(weight).alias("_w"), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics))).alias("_m"))
    long = long.select(*keys, "_w", "_m.metric", "_m.x").where(finite(F.col("x")))
    g = long.groupBy(*keys, "metric").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), (F.sum(F.col("x") * F.col("_w")) / F.nullif(F.sum("_w"), F.lit(0.0))).alias("weighted_mean"))
    return with_quantiles(g, long, [*keys, "metric"], {"median": ("x", 0.5), "p10": ("x", 0.1), "p90": ("x", 0.9)})


def retention(windows: DataFrame, keys: Keys, duration: Column, accept: str, event: str) -> DataFrame:
    """Windows and seconds kept of all, event and baseline windows, a row a recording."""
    parts = {"all": F.lit(True), "event": F.col(event), "baseline": ~F.col(event)}
    aggs = []
    for name, cond in parts.items():
        aggs += [
            F.count(F.when(cond, 1)).alias(f"n_{name}"), F.count(F.when(cond & F.col(accept), 1)).alias(f"kept_{name}"),
            F.coalesce(F.sum(F.when(cond, duration)), F.lit(0.0)).alias(f"sec_{name}"), F.coalesce(F.sum(F.when(cond & F.col(accept), duration)), F.lit(0.0)).alias(f"sec_kept_{name}"),
        ]
    g = windows.groupBy(*keys).agg(*aggs)
    return g.withColumns({f"share_{p}": F.col(f"sec_kept_{p}") / F.nullif(F.col(f"sec_{p}"), F.lit(0.0)) for p in parts})


def retention_by_event(pairs: DataFrame, keys: Keys, idx: list[str], event: list[str], accept: str) -> DataFrame:
    """Windows that overlap each event, and how many of them are kept; a window counts once an event."""
    one = pairs.select(*keys, *idx, *event, accept).distinct()
    return one.groupBy(*keys, *event).agg(F.count("*").alias("n_windows"), F.count(F.when(F.col(accept), 1)).alias("n_kept"), F.avg(F.col(accept).cast("int")).alias("share_kept"))


def flag_table(windows: DataFrame, flags: list[str], event: str) -> DataFrame:
    """Share of each flag among all, event and baseline windows: the three groups overlap, so each window is in two."""
    groups = F.array(F.lit("all"), F.when(F.col(event), F.lit("event")).otherwise(F.lit("baseline")))
    x = windows.withColumn("group", F.explode(groups))
    return x.groupBy("group").agg(F.count("*").alias("n_windows"), *(F.avg(F.col(f).cast("int")).alias(f"frac_{f}") for f in flags))


def error_enrichment(errors: DataFrame, windows: DataFrame, keys: Keys, accept: str, duration: Column, bounds: DataFrame | None = None, w: tuple[str, str] = ("win_start_s", "win_end_s")) -> DataFrame:
    """Errors, minutes of exposure and errors a minute by acceptance; exposure within `bounds` (t_min, t_max) of the recording, where given."""
    x = windows
    if bounds is not None:
        x = x.join(bounds, keys).where((F.col(w[1]) > F.col("t_min")) & (F.col(w[0]) < F.col("t_max")))
        duration = F.least(F.col(w[1]), F.col("t_max")) - F.greatest(F.col(w[0]), F.col("t_min"))
    exposure = x.groupBy(accept).agg((F.sum(duration) / 60.0).alias("minutes"))
    n = errors.groupBy(accept).agg(F.count("*").alias("n_errors"))
    g = exposure.join(n, accept, "left").na.fill(0, ["n_errors"])
    return g.withColumn("errors_per_min", F.col("n_errors") / F.nullif(F.col("minutes"), F.lit(0.0)))


def rejection_around_onset(windows: DataFrame, events: DataFrame, keys: Keys, start: str, onset: str, accept: str, event_id: list[str], pre: float, post: float, step: float) -> DataFrame:
    """Share of rejected windows by bin of time to the onset: first a mean for each event, then of those."""
    near = events.select(*keys, *event_id, F.col(onset).alias("_on"), (F.col(onset) - pre - 1).alias("_e0"), (F.col(onset) + post + 1).alias("_e1"))
    at = windows.select(*keys, start, accept).withColumn("_s", F.col(start))
    x = overlap_pairs(at, near, keys, (start, "_s"), ("_e0", "_e1"), closed=True).withColumn("_rel", F.col(start) - F.col("_on")).where(F.col("_rel").between(-pre, post))
    x = x.withColumn("bin_s", F.floor(F.col("_rel") / step) * step)
    each = x.groupBy(*keys, *event_id, "bin_s").agg(F.avg((~F.col(accept)).cast("int")).alias("_r"))
    return each.groupBy("bin_s").agg(F.avg("_r").alias("rejection_rate"), F.count("*").alias("n_events"))


def window_label(labels: DataFrame, keys: Keys, window: str, label: str) -> DataFrame:
    """The most frequent label above 0 of each window; of equally frequent ones, the smallest."""
    n = labels.where(F.col(label) > 0).groupBy(*keys, window, label).agg(F.count("*").alias("_n"))
    best = n.groupBy(*keys, window).agg(F.min(F.struct((-F.col("_n")).alias("m"), F.col(label))).alias("b"))
    return best.select(*keys, window, F.col(f"b.{label}").alias(label))


def population_thresholds(features: DataFrame, upper: dict[str, float], lower: dict[str, float]) -> DataFrame:
    """One row of percentile thresholds over finite values: infinity (upper) or 0 (lower) where there is none."""
    known = lambda c: F.when(finite(F.col(c)), F.col(c))
    wanted = {f"{c}_max": (known(c), q) for c, q in upper.items()} | {f"{c}_min": (known(c), q) for c, q in lower.items()}
    got = quantiles(features, [], wanted)
    return got.select(*(F.coalesce(n, F.lit(float("inf") if n.removesuffix("_max") in upper and n.endswith("_max") else 0.0)).alias(n) for n in wanted))


def classify_segments(features: DataFrame, upper: dict[str, float], lower: dict[str, float]) -> DataFrame:
    """A flag for each limit passed, the share that is fine, and whether all are; missing values pass."""
    flags = {f"bad_{c}_high": F.coalesce(F.col(c) > v, F.lit(False)) for c, v in upper.items()} | {f"bad_{c}_low": F.coalesce(F.col(c) < v, F.lit(False)) for c, v in lower.items()}
    x = features.withColumns(flags)
    bad = sum((F.col(f).cast("int") for f in flags), F.lit(0))
    return x.withColumns({"score": 1 - bad / float(len(flags)), "is_good": bad == 0})


def noisy_share(df: DataFrame, keys: Keys, col: str, cut: float) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(col) > cut).cast("int")).alias("noisy_ratio"))


def window_badness(rms_bad: Column, quality_bad: Column, rr_bad: Column, cut: float = 0.4) -> tuple[Column, Column]:
    """Weighted badness of a window (0.5, 0.3, 0.2) and whether it is above the cut."""
    score = 0.5 * rms_bad.cast("int") + 0.3 * quality_bad.cast("int") + 0.2 * rr_bad.cast("int")
    return score, score > cut


def safe_ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(TINY))

"""Sums over ranges of time from prefix sums: each point and each end of a range is one row, whatever the ranges overlap.

A running sum over a recording's points is looked up at both ends of a range;
their difference is the range's sum. Long recordings run in blocks of time
(`scan`). Sums are of decimals, so differences are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatlake.operators import scan

Keys = list[str]
#: Nine digits behind the point, for times and values; squares have twice as many.
NUMBER, SQUARE = "decimal(28,9)", "decimal(38,18)"


def prefixes(points: DataFrame, at: DataFrame, keys: Keys, t: str, x: str, values: dict[str, Column], block: float | None = None, following: Column | None = None) -> DataFrame:
    """`at` with the sums of `values` over the recording's points before its time `x`, and `_n`, their number; with `following` of the first point at or after it."""
    p = points.select(*keys, F.col(t).cast("double").alias("_t"), F.lit(1).alias("_side"), *(v.alias(f"_v{i}") for i, v in enumerate(values.values())), *([following.alias("_f")] if following is not None else []))
    q = at.select(*keys, F.col(x).cast("double").alias("_t"), F.lit(0).alias("_side"), F.struct(*at.columns).alias("_a"))
    both = scan.blocked(p.where("_t is not null").unionByName(q, allowMissingColumns=True), "_t", block)
    if following is not None:
        both = scan.carried(both, keys, [F.min(F.when(F.col("_side") == 1, F.struct("_t", F.struct("_f").alias("_b")))).alias("_first")], lambda s: s.select(*keys, "_block", F.min("_first").over(scan.later(keys))["_b"].alias("_far")), block, ["_far"])
        last = F.last(F.when(F.col("_side") == 1, F.struct("_f")), ignorenulls=True).over(scan.within(keys).orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(scan.W.unboundedPreceding, 0))
        both = both.withColumn("_f", F.coalesce(last, "_far")["_f"]).drop("_far")
    sums = {"_n": F.col("_side").cast("bigint")} | {name: F.coalesce(F.col(f"_v{i}"), F.lit(0)) for i, name in enumerate(values)}
    both = scan.running_sums(both, keys, ["_t", "_side"], sums, block).where("_side = 0")
    return both.select("_a.*", "_n", *values, *(["_f"] if following is not None else []))


def ends_of(ranges: DataFrame, keys: Keys, idx: Keys, bounds: tuple[str, str]) -> DataFrame:
    ends = F.array(F.struct(F.col(bounds[0]).cast("double").alias("x"), F.lit(-1).alias("sign")), F.struct(F.col(bounds[1]).cast("double").alias("x"), F.lit(1).alias("sign")))
    return ranges.select(*keys, *idx, F.explode(ends).alias("_e")).select(*keys, *idx, F.col("_e.x").alias("_x"), F.col("_e.sign").alias("_sign"))


def range_sums(points: DataFrame, ranges: DataFrame, keys: Keys, idx: Keys, t: str, bounds: tuple[str, str], values: dict[str, Column], block: float | None = None, following: Column | None = None) -> DataFrame:
    """keys, idx, `n` and the sums of `values` over the points of each range (start included, end not); ranges are unique by keys and idx.

    With `following`, `first` is that of the range's first point.
    """
    x = prefixes(points, ends_of(ranges, keys, idx, bounds), keys, t, "_x", values, block, following)
    more = [F.max(F.when(F.col("_sign") < 0, F.struct("_f")))["_f"].alias("first")] if following is not None else []
    g = x.groupBy(*keys, *idx).agg(F.sum(F.col("_n") * F.col("_sign")).alias("n"), *(F.sum(F.col(v) * F.col("_sign")).alias(v) for v in values), *more)
    return g


def covered(targets: DataFrame, windows: DataFrame, keys: Keys, idx: Keys, a: tuple[str, str], w: tuple[str, str], block: float | None = None) -> DataFrame:
    """keys, idx and `covered`: how much of each target windows cover, overlaps summed.

    What windows cover before a time is that time for each that is open,
    less the starts and with the ends of all before it; so one running sum
    over starts and ends answers for any target.
    """
    ends = F.array(*(F.struct(F.col(c).cast("double").alias("t"), F.lit(sign).alias("sign")) for c, sign in zip(w, (1, -1))))
    points = windows.where(F.col(w[1]) > F.col(w[0])).select(*keys, F.explode(ends).alias("_e")).select(*keys, F.col("_e.t").alias("t"), F.col("_e.sign").alias("sign"))
    sums = {"_open": F.col("sign").cast("bigint"), "_moved": F.col("t").cast(NUMBER) * F.col("sign")}
    x = prefixes(points, ends_of(targets, keys, idx, a), keys, "t", "_x", sums, block)
    before = F.col("_x").cast(NUMBER) * F.col("_open") - F.col("_moved")
    return x.groupBy(*keys, *idx).agg(F.sum(before * F.col("_sign")).cast("double").alias("covered"))


def squared(x: Column) -> Column:
    return (x.cast("decimal(19,9)") * x.cast("decimal(19,9)")).cast(SQUARE)


def deviation(n: Column, total: Column, squares: Column) -> Column:
    """Sample deviation from a count, a sum and a sum of squares; null below two."""
    s, q = total.cast("double"), squares.cast("double")
    return F.when(n > 1, F.sqrt(F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1)))


def window_hrv(beats: DataFrame, windows: DataFrame, keys: Keys, idx: Keys, order: list[str], t: str, rr: str, bounds: tuple[str, str], least: int = 10, block: float | None = None) -> DataFrame:
    """Variability (ms) of the beats of each window with `least` beats or more: n_rr, mean_nn, sdnn, rmssd, sdsd, pnn50, sd1, sd2, sd_ratio.

    A difference counts in a window that holds both of its beats, so that of
    a window's first beat is taken off its sums.
    """
    x = scan.lagged(beats, keys, [t, *order], t, rr, block, "_p").withColumn("_d", F.col(rr) - F.col("_p"))
    d, big = F.col("_d"), (F.abs("_d") > 50).cast("bigint")
    parts = {"s": F.col(rr).cast(NUMBER), "q": squared(F.col(rr)), "sd": d.cast(NUMBER), "qd": squared(d), "nd": d.isNotNull().cast("bigint"), "big": big}
    first = F.struct(*(F.coalesce(parts[c], F.lit(0)).alias(c) for c in ("sd", "qd", "nd", "big")))
    g = range_sums(x, windows, keys, idx, t, bounds, parts, block, first).where(F.col("n") >= least)
    g = g.withColumns({c: F.col(c) - F.col(f"first.{c}") for c in ("sd", "qd", "nd", "big")})
    n, nd = F.col("n"), F.nullif(F.col("nd"), F.lit(0))
    g = g.select(
        *keys, *idx, n.alias("n_rr"), (F.col("s").cast("double") / n).alias("mean_nn"), deviation(n, F.col("s"), F.col("q")).alias("sdnn"),
        F.sqrt(F.col("qd").cast("double") / nd).alias("rmssd"), deviation(nd, F.col("sd"), F.col("qd")).alias("sdsd"), (F.col("big") / nd).alias("pnn50"),
    )
    g = g.withColumn("sd1", F.col("sdsd") / F.sqrt(F.lit(2.0)))
    g = g.withColumn("sd2", F.sqrt(F.greatest(2 * F.col("sdnn") * F.col("sdnn") - F.col("sd1") * F.col("sd1"), F.lit(0.0))))
    return g.withColumn("sd_ratio", F.col("sd2") / F.when(F.col("sd1") > 0, F.col("sd1")))

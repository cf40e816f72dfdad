"""Joins on time: overlap, containment, as-of, nearest, coverage.

Overlap joins are equi-joins on the recording and on nodes of a binary tree of
time (`overlap_pairs`), so long recordings are dealt over tasks, intervals
compare with neighbours only, and no block length has to suit all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beatlake.operators import scan
from beatlake.operators.ranges import covered

Keys = list[str]
#: The finest level's nodes are a second long; a level more doubles them.
FINEST = 0


def overlaps(ws: Column, we: Column, t0: Column, t1: Column, closed: bool = False) -> Column:
    return (ws <= t1) & (we >= t0) if closed else (ws < t1) & (we > t0)


def level(start: Column, end: Column) -> Column:
    """The finest level whose nodes are as long as the interval, which lies in two neighbours of them at most."""
    return F.greatest(F.ceil(F.log2(F.greatest(F.abs(end - start), F.lit(2.0**FINEST)))), F.lit(FINEST)).cast("int")


def nodes(rows: DataFrame, start: Column, end: Column, others: DataFrame) -> DataFrame:
    """`rows` once for each node (`_level`, `_node`) they touch at their own level and at each coarser one that `others` have intervals of.

    `others` is asked for its levels in a scalar subquery: a few numbers.
    """
    x = rows.withColumn("_coarser", others.select(F.collect_set("_own")).scalar())
    levels = F.concat(F.array("_own"), F.filter("_coarser", lambda c: c > F.col("_own")))
    x = x.withColumn("_level", F.explode(levels)).drop("_coarser")
    size = F.pow(F.lit(2.0), F.col("_level"))
    return x.withColumn("_node", F.explode(F.sequence(F.floor(F.least(start, end) / size), F.floor(F.greatest(start, end) / size))))


def overlap_pairs(windows: DataFrame, events: DataFrame, keys: Keys, w: tuple[str, str], e: tuple[str, str], closed: bool = False) -> DataFrame:
    """Pairs of windows and events of a recording that overlap (left columns, then the event's but its keys); each once.

    An interval belongs to the two nodes at most that it touches at the level
    of its own length, and is also looked up at the coarser levels that the
    other side uses. Two intervals that overlap touch a common node at the
    coarser of their levels, and count at the one that holds the later of
    their starts. So a day-long event among windows of ten seconds is two
    rows, and each window one or two more.
    """
    a = windows.withColumn("_own", level(F.col(w[0]), F.col(w[1])))
    b = events.withColumn("_own", level(F.col(e[0]), F.col(e[1])))
    x, y = nodes(a, F.col(w[0]), F.col(w[1]), b).alias("a"), nodes(b, F.col(e[0]), F.col(e[1]), a).alias("b")
    w0, w1, e0, e1 = F.col(f"a.{w[0]}"), F.col(f"a.{w[1]}"), F.col(f"b.{e[0]}"), F.col(f"b.{e[1]}")
    later = F.greatest(F.least(w0, w1), F.least(e0, e1))
    on = (F.col("a._level") == F.col("b._level")) & (F.col("a._node") == F.col("b._node"))
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    once = (F.col("a._level") == F.greatest("a._own", "b._own")) & (F.col("a._node") == F.floor(later / F.pow(F.lit(2.0), F.col("a._level"))))
    # rows a node are many times what Spark expects from the size of files, so it may not choose to send a side whole to all tasks
    out = x.join(y.hint("merge"), on & once & overlaps(w0, w1, e0, e1, closed))
    return out.select(*(F.col(f"a.{c}") for c in windows.columns), *(F.col(f"b.{c}") for c in events.columns if c not in keys))


def overlap_flag(windows: DataFrame, events: DataFrame, keys: Keys, idx: list[str], w: tuple[str, str], e: tuple[str, str], closed: bool = False, out: str = "overlaps_event") -> DataFrame:
    """`windows` (unique by keys and idx) with whether any event of the recording overlaps it."""
    if out in windows.columns:
        return windows
    pairs = overlap_pairs(windows, events.select(*keys, *dict.fromkeys(e)), keys, w, e, closed)
    hit = pairs.select(*keys, *idx).distinct().withColumn(out, F.lit(True))
    return windows.join(hit, [*keys, *idx], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def asof_window(points: DataFrame, windows: DataFrame, keys: Keys, t: str, start: str, end: str, take: list[str], order: list[str], block: float | None = None) -> DataFrame:
    """Each point with the columns `take` of the latest window that started at or before it and has not ended; others go.

    A union of both sides and one ordered window function: no pairs are made,
    so it costs a sort whatever the overlap. With a `block` of time a
    recording is dealt over tasks (`scan`). Of windows with one start, the one
    that ends last counts.
    """
    payload = F.struct(F.col(end).alias("_e"), *(F.col(c).alias(f"w_{c}") for c in take))
    right = windows.select(*keys, F.col(start).cast("double").alias("_t"), F.lit(0).alias("_side"), payload.alias("_w"))
    left = points.select(*keys, F.col(t).cast("double").alias("_t"), F.lit(1).alias("_side"), F.struct(*points.columns).alias("_p"))
    both = scan.blocked(right.unionByName(left, allowMissingColumns=True), "_t", block)
    latest = F.max(F.struct("_at", "_carried")).over(scan.earlier(keys))
    summary = [F.max(F.when(F.col("_side") == 0, F.struct(F.col("_t").alias("_at"), F.col("_w").alias("_carried")))).alias("_top")]
    x = scan.carried(both, keys, summary, lambda s: s.select(*keys, "_block", "_top.*").withColumn("_far", latest["_carried"]), block, ["_far"])
    w = scan.within(keys).orderBy("_t", "_side", *([F.col(f"_p.{o}") for o in order]), F.col("_w._e"))
    x = x.withColumn("_w", F.coalesce(F.last("_w", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), "_far")).where("_side = 1")
    return x.where((F.col("_w").isNotNull()) & (F.col("_t") < F.col("_w._e"))).select("_p.*", *(F.col(f"_w.w_{c}").alias(c) for c in take))


def nearest(left: DataFrame, right: DataFrame, keys: Keys, t_left: str, t_right: str, tolerance: float | None = None, out: str = "t_near", block: float | None = None) -> DataFrame:
    """`left` with the nearest time of the right side (the earlier of equally near ones) and signed dt; null beyond the tolerance.

    The right time before each row is the last of a running frame, the one
    after it the last of a running frame from the end. With a `block` of time
    a recording is dealt over tasks, and a block gets the nearest right times
    of the blocks around it (`scan`).
    """
    a = left.select(*keys, F.col(t_left).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_p"))
    b = right.select(*keys, F.col(t_right).alias("_t"), F.lit(0).alias("_side"), F.col(t_right).alias("_r")).where(F.col("_r").isNotNull())
    x = scan.blocked(a.unionByName(b, allowMissingColumns=True), "_t", block)
    around = lambda s: s.withColumns({"_far_b": F.max("_hi").over(scan.earlier(keys)), "_far_a": F.min("_lo").over(scan.later(keys))})
    x = scan.carried(x, keys, [F.min("_r").alias("_lo"), F.max("_r").alias("_hi")], around, block, ["_far_b", "_far_a"])
    running = lambda *order: scan.within(keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = F.coalesce(F.last("_r", ignorenulls=True).over(running("_t", "_side")), "_far_b")
    after = F.coalesce(F.last("_r", ignorenulls=True).over(running(F.desc("_t"), F.desc("_side"))), "_far_a")
    x = x.select("*", before.alias("_b"), after.alias("_a")).where("_side = 1")
    pick = F.when(F.col("_a").isNull() | (F.col("_t") - F.col("_b") <= F.col("_a") - F.col("_t")), F.col("_b")).otherwise(F.col("_a"))
    x = x.withColumn("_n", F.when(F.col("_t").isNotNull(), F.coalesce(pick, "_b", "_a")))
    if tolerance is not None:
        x = x.withColumn("_n", F.when(F.abs(F.col("_n") - F.col("_t")) <= tolerance, F.col("_n")))
    return x.select("_p.*", F.col("_n").alias(out), (F.col("_n") - F.col("_t")).alias("dt"))


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: Keys, t: str, e: tuple[str, str], pad: float = 0.0, out: str = "inside") -> DataFrame:
    """`points` with whether they lie in an interval of the recording, widened by `pad`."""
    wide = intervals.select(*keys, (F.col(e[0]) - pad).alias("_t0"), (F.col(e[1]) + pad).alias("_t1"))
    span = points.select(*keys, F.col(t).alias("_x")).distinct()
    hit = overlap_pairs(span.withColumn("_y", F.col("_x")), wide, keys, ("_x", "_y"), ("_t0", "_t1"), closed=True).select(*keys, F.col("_x").alias(t)).distinct()
    return points.join(hit.withColumn(out, F.lit(True)), [*keys, t], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def coverage(targets: DataFrame, windows: DataFrame, keys: Keys, idx: list[str], a: tuple[str, str], w: tuple[str, str], out: str = "coverage", block: float | None = None) -> DataFrame:
    """`targets` (unique by keys and idx) with the share of their length that the windows cover (summed overlaps)."""
    got = covered(targets, windows, keys, idx, a, w, block).withColumnRenamed("covered", "_s")
    length = F.col(a[1]) - F.col(a[0])
    return targets.join(got, [*keys, *idx], "left").withColumn(out, F.when(length > 0, F.coalesce("_s", F.lit(0.0)) / length)).drop("_s")


def floor_window(points: DataFrame, windows: DataFrame, keys: Keys, t: str, length: float, take: list[str], idx: str = "window_idx") -> DataFrame:
    """Each point with columns of window number floor(t / length); null where there is none."""
    x = points.withColumn(idx, F.floor(F.col(t) / length).cast("bigint"))
    # windows grow with the recordings, and their files are far smaller than their rows: never sent whole to all tasks
    return x.join(windows.select(*keys, idx, *take).hint("merge"), [*keys, idx], "left")


def null_safe_lookup(rows: DataFrame, table: DataFrame, on: list[str], take: list[str], order: list[str], strict: bool = False) -> DataFrame:
    """`rows` with columns of the first match in `table` on null-safe keys; null without one, or an error where strict and not exactly one."""
    w = W.partitionBy(*on)
    one = table.select(*on, *take, F.row_number().over(w.orderBy(*order)).alias("_rn"), F.count(F.lit(1)).over(w).alias("_n")).where("_rn = 1")
    a, b = rows.alias("a"), one.alias("b")
    cond = F.lit(True)
    for k in on:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    x = a.join(b, cond, "left").select("a.*", *(F.col(f"b.{c}") for c in take), F.col("b._n"))
    if strict:
        x = x.withColumn("_n", F.when(F.coalesce("_n", F.lit(0)) == 1, F.col("_n")).otherwise(F.raise_error(F.lit("lookup without exactly one match")).cast("bigint"))).where("_n = 1")
    return x.drop("_n")


def crop(points: DataFrame, bounds: DataFrame, keys: Keys, t: str, low: str, high: str) -> DataFrame:
    """Points within their recording's bounds, ends included."""
    return points.join(bounds.select(*keys, low, high), keys).where(F.col(t).between(F.col(low), F.col(high))).drop(low, high)


def common_range(a: DataFrame, b: DataFrame, keys: Keys, t: str) -> DataFrame:
    """The time range that both trains of a recording share: overlap_start, overlap_end; empty ranges go."""
    x = a.groupBy(*keys).agg(F.min(t).alias("_a0"), F.max(t).alias("_a1"))
    y = b.groupBy(*keys).agg(F.min(t).alias("_b0"), F.max(t).alias("_b1"))
    z = x.join(y, keys).select(*keys, F.greatest("_a0", "_b0").alias("overlap_start"), F.least("_a1", "_b1").alias("overlap_end"))
    return z.where("overlap_start <= overlap_end")


def near_range(events: DataFrame, spans: DataFrame, keys: Keys, t: str, low: str, high: str, pad: float) -> DataFrame:
    """Events within a recording's span widened by `pad`."""
    x = events.join(spans.select(*keys, low, high), keys)
    return x.where((F.col(t) >= F.col(low) - pad) & (F.col(t) <= F.col(high) + pad)).select(*events.columns)

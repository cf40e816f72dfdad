"""Matching of two event trains within a tolerance, and what follows from it."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatlake.functions.scalars import correlation, scaled_round
from beatlake.operators import scan

Keys = list[str]
# Rows either side may be off by in floating point.
SLACK = 1e-9
#: Runs of events without a gap that are matched in one task, where recordings are cut.
PIECE = 1024


def band_match(ref: DataFrame, test: DataFrame, keys: Keys, t: str, tol: float) -> DataFrame:
    """All pairs within `tol` as an equi-join on blocks of that length; one to one if both trains keep more than 2 tol between events."""
    block = tol * 2 if tol > 0 else 1.0
    a = ref.select(*keys, F.col(t).alias("t_ref")).withColumn("_k", F.floor(F.col("t_ref") / block))
    b = test.select(*keys, F.col(t).alias("t_test")).withColumn("_b", F.floor(F.col("t_test") / block))
    b = b.withColumn("_k", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1))).drop("_b")
    return a.join(b, [*keys, "_k"]).where(F.abs(F.col("t_test") - F.col("t_ref")) <= tol + SLACK).drop("_k")


def greedy_match(ref: DataFrame, test: DataFrame, keys: Keys, t: str, tol: float | list[float], shift: float = 0.0, block: float | None = None) -> DataFrame:
    """One row an event: kind TP (t_ref and t_test), FN (t_ref) or FP (t_test); the test train is moved by `shift` first.

    One exchange and one pass over sorted events, which holds those of one
    train that wait for the other's next: the earliest pair within the
    tolerance matches, the earlier of a pair beyond it is passed. Sequential within a
    recording, but no match spans a gap longer than the tolerance; with a
    `block` of time, recordings are cut at such gaps and dealt over tasks
    (`scan`). An empty train leaves only FN or FP; events without a time are
    left out. With a list of tolerances each is matched in the same plan, and
    tol_s is a column.
    """
    many = isinstance(tol, list)
    spine = F.array(*(F.lit(float(x)) for x in (tol if many else [tol])))
    side = lambda df, s, moved: df.select(*keys, (F.col(t).cast("double") + moved).alias("_t"), F.lit(s).alias("_s"))
    both = side(ref, 0, 0.0).unionByName(side(test, 1, float(shift))).where("_t is not null").withColumn("_tol", F.explode(spine))
    series = [*keys, "_tol"]
    piece = F.lit(0)
    if block is not None:
        both = scan.groups_apart(both, series, ["_s"], "_t", F.col("_tol") + 2 * SLACK, block, "_p")
        piece = F.floor(F.col("_p") / PIECE)
    dealt = both.withColumn("_p", piece.cast("bigint"))
    schema = T.StructType([*(ref.schema[k] for k in keys), *([T.StructField("tol_s", T.DoubleType())] if many else []), T.StructField("kind", T.StringType()), T.StructField("t_ref", T.DoubleType()), T.StructField("t_test", T.DoubleType())])
    n = len(keys)

    def make():
        now: tuple | None = None
        name: tuple = ()
        tolerance, waiting, train = 0.0, deque(), 0
        alone = lambda x: (*name, "FN", x, None) if train == 0 else (*name, "FP", None, x)

        def call(columns):
            nonlocal now, name, tolerance, train
            out: list[tuple] = []
            if columns is None:
                out.extend(map(alone, waiting))
                waiting.clear()
                return out
            for key, x, of in zip(zip(*columns[: n + 2]), columns[n + 2], columns[n + 3]):
                if key != now:
                    out.extend(map(alone, waiting))
                    waiting.clear()
                    now, name, tolerance = key, key[: n + 1] if many else key[:n], key[n]
                while waiting and of != train:
                    first = waiting.popleft()
                    if x - first <= tolerance + SLACK:
                        out.append((*name, "TP", first, x) if of else (*name, "TP", x, first))
                        break
                    out.append(alone(first))
                else:
                    train = of
                    waiting.append(x)
            return out

        return call

    return scan.stream(dealt, [*series, "_p", "_t", "_s"], [*series, "_p", "_t", "_s"], [*series, "_p"], schema, make)


def metrics(matched: DataFrame, keys: Keys) -> DataFrame:
    """Counts, sensitivity, positive predictive value and F1 (null where undefined), median and 95th percentile of dt."""
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    dt = F.when(F.col("kind") == "TP", (F.col("t_test") - F.col("t_ref")) * 1000)
    g = matched.groupBy(*keys).agg(n("TP").alias("tp"), n("FN").alias("fn"), n("FP").alias("fp"), F.median(dt).alias("median_dt_ms"), F.percentile(F.abs(dt), F.lit(0.95)).alias("p95_abs_dt_ms"))
    return with_rates(g)


def with_rates(g: DataFrame) -> DataFrame:
    tp, fn, fp = (F.col(c) for c in ("tp", "fn", "fp"))
    return g.withColumns({"sens": tp / F.nullif(tp + fn, F.lit(0)), "ppv": tp / F.nullif(tp + fp, F.lit(0)), "f1": 2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0))})


def match_counts(pairs: DataFrame, ref: DataFrame, test: DataFrame, keys: Keys) -> DataFrame:
    """Counts and rates of a one-to-one match from its pairs and the sizes of both trains."""
    g = ref.groupBy(*keys).agg(F.count("*").alias("n_ref")).join(test.groupBy(*keys).agg(F.count("*").alias("n_test")), keys, "full")
    g = g.join(pairs.groupBy(*keys).agg(F.count("*").alias("tp")), keys, "left").na.fill(0, ["n_ref", "n_test", "tp"])
    return with_rates(g.select(*keys, "tp", (F.col("n_ref") - F.col("tp")).alias("fn"), (F.col("n_test") - F.col("tp")).alias("fp")))


class Grid:
    """Offsets in rising order, the place of each in the list that was given, and which of them an interval holds."""

    def __init__(self, offsets: list[float]):
        place: dict[float, int] = {}
        for i, o in enumerate(map(float, offsets)):
            place.setdefault(o, i)
        self.values = sorted(place)
        self.places = [place[v] for v in self.values]
        self.first, self.last, self.n = self.values[0], self.values[-1], len(self.values)
        self.step = (self.last - self.first) / max(self.n - 1, 1) or 1.0
        self.even = all(abs(self.first + i * self.step - v) <= 1e-6 * self.step for i, v in enumerate(self.values))

    def from_(self, low: Column) -> Column:
        """Index of the first offset from `low` on; by arithmetic where they are evenly spaced."""
        if self.even:
            return F.ceil((low - self.first) / self.step)
        return F.size(F.filter(F.array(*map(F.lit, self.values)), lambda v: v < low)).cast("bigint")

    def to(self, high: Column) -> Column:
        """Index of the last offset up to `high`."""
        if self.even:
            return F.floor((high - self.first) / self.step)
        return F.size(F.filter(F.array(*map(F.lit, self.values)), lambda v: v <= high)).cast("bigint") - 1

    def place(self, at: str, until: str) -> Column:
        """The least place in the given list of the offsets from one index up to another."""
        if self.places == sorted(self.places):
            return F.col(at)
        return F.array_min(F.slice(F.array(*map(F.lit, self.places)), F.col(at).cast("int") + 1, (F.col(until) - F.col(at)).cast("int"))).cast("bigint")

    def value(self, place: Column) -> Column:
        if self.even and self.places == sorted(self.places):
            return F.round(self.first + place * self.step, 9)
        given = dict(zip(self.places, self.values))
        return F.element_at(F.create_map(*(F.lit(x) for i, v in given.items() for x in (i, v))), place.cast("int"))


def near_pairs(ref: DataFrame, test: DataFrame, keys: Keys, grid: Grid, tol: float) -> DataFrame:
    """Pairs of `_r` and `_t` (with the other columns of both) that some offset brings within `tol`, and `_from` and `_to`, the indices of these offsets.

    Trains are joined on blocks of time as long as the range of offsets, so a
    pair is made once, whatever the number of offsets.
    """
    span = grid.last - grid.first + 2 * tol + grid.step
    a = ref.withColumn("_k", F.floor((F.col("_r") - grid.first) / span))
    b = test.withColumn("_k", F.explode(F.array(*(F.floor(F.col("_t") / span) + d for d in (-1, 0, 1)))))
    x = a.join(b, [*keys, "_k"])
    apart = F.col("_r") - F.col("_t")
    x = x.withColumns({"_from": grid.from_(apart - tol - SLACK), "_to": grid.to(apart + tol + SLACK)})
    return x.where((F.col("_from") <= F.col("_to")) & (F.col("_to") >= 0) & (F.col("_from") < grid.n)).drop("_k")


def swept(pairs: DataFrame, keys: Keys, grid: Grid, sums: dict[str, Column]) -> DataFrame:
    """Sums over the pairs whose range of indices holds an offset, at each index (`_at`, up to `_until`) where they change: what begins is added, what ended is taken away, in one running sum."""
    ends = F.array(F.struct(F.greatest("_from", F.lit(0)).alias("at"), F.lit(1).alias("sign")), F.struct((F.col("_to") + 1).alias("at"), F.lit(-1).alias("sign")))
    x = pairs.withColumn("_e", F.explode(ends)).where(F.col("_e.at") < grid.n)
    x = x.groupBy(*keys, F.col("_e.at").alias("_at")).agg(*(F.sum(v * F.col("_e.sign")).alias(c) for c, v in sums.items()))
    w = W.partitionBy(*keys).orderBy("_at")
    until = F.coalesce(F.lead("_at").over(w), F.lit(grid.n))
    x = x.select(*keys, "_at", until.alias("_until"), *(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, 0)).alias(c) for c in sums))
    return x.withColumn("_place", grid.place("_at", "_until"))


def offset_search(ref: DataFrame, test: DataFrame, keys: Keys, t: str, offsets: list[float], tol: float) -> DataFrame:
    """For each recording the offset of the test train that matches most reference events; ties to the first of the list.

    A near pair gives an interval of good offsets. Those of one reference
    event are made disjoint, so it counts once; their ends, +1 and -1, and one
    running sum give the count at every offset. The count changes only where
    an interval begins or ends, so with evenly spaced offsets cost doesn't
    follow their number.
    """
    grid = Grid(offsets)
    a = ref.select(*keys, F.col(t).alias("_r")).where("_r is not null").distinct()
    b = test.select(*keys, F.col(t).alias("_t")).where("_t is not null").distinct()
    b = b.withColumn("_next", F.lead("_t").over(W.partitionBy(*keys).orderBy("_t")))
    x = near_pairs(a, b, keys, grid, tol)
    # offsets that bring the next test event near come first, and count there
    taken = grid.to(F.col("_r") - F.col("_next") + tol + SLACK) + 1
    x = x.withColumn("_from", F.greatest("_from", taken)).where("_from <= _to and _to >= 0")
    best = swept(x, keys, grid, {"tp": F.lit(1)}).where("tp > 0").groupBy(*keys).agg(F.min(F.struct((-F.col("tp")).alias("m"), "_place", "tp")).alias("b"))
    return best.select(*keys, grid.value(F.col("b._place")).alias("best_offset"), F.col("b.tp").alias("tp"))


def rr_delta_search(ref: DataFrame, test: DataFrame, keys: Keys, t: str, rr: str, deltas: list[float], tol: float, least: int = 5) -> DataFrame:
    """The delta that gives the smallest mean absolute difference of intervals matched by start time, with `least` matches or more; the first of equals.

    As `offset_search`: a pair adds itself and its difference to all deltas that match it. Sums are decimals, so what is taken away leaves nothing.
    """
    grid = Grid(deltas)
    a = ref.select(*keys, F.col(t).alias("_r"), F.col(rr).alias("_rr"))
    b = test.select(*keys, F.col(t).alias("_t"), F.col(rr).alias("_rt"))
    differs = F.coalesce(F.abs(F.col("_rr") - F.col("_rt")) * 1000, F.lit(0.0)).cast("decimal(24,9)")
    known = (F.col("_rr") - F.col("_rt")).isNotNull().cast("int")
    x = swept(near_pairs(a, b, keys, grid, tol), keys, grid, {"n": F.lit(1), "_known": known, "_sum": differs})
    x = x.where(F.col("n") >= least).withColumn("m", scaled_round(F.col("_sum").cast("double") / F.nullif(F.col("_known"), F.lit(0)), 9))
    best = x.groupBy(*keys).agg(F.min(F.struct("m", "_place", "n")).alias("b"))
    return best.select(*keys, grid.value(F.col("b._place")).alias("best_delta"), F.col("b.m").alias("mae_ms"), F.col("b.n").alias("n"))


def lag_search(ref: DataFrame, test: DataFrame, keys: Keys, idx: str, most: int) -> DataFrame:
    """The integer lag within ±most at which most events coincide; ties to the smallest absolute lag, then the smaller."""
    a = ref.select(*keys, F.col(idx).alias("_a")).withColumn("_k", F.floor(F.col("_a") / (most + 1)))
    b = test.select(*keys, F.col(idx).alias("_b")).withColumn("_k", F.explode(F.array(*(F.floor(F.col("_b") / (most + 1)) + d for d in (-1, 0, 1)))))
    lags = a.join(b, [*keys, "_k"]).withColumn("lag", F.col("_b") - F.col("_a")).where(F.abs("lag") <= most)
    g = lags.groupBy(*keys, "lag").agg(F.count("*").alias("n"))
    best = g.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.abs("lag").alias("d"), "lag", "n")).alias("b"))
    return best.select(*keys, F.col("b.lag").alias("lag"), F.col("b.n").alias("coincidences"))


def rr_agreement(pairs: DataFrame, keys: Keys, ref: str, test: str) -> DataFrame:
    """Mean absolute and root mean square error (ms), correlation, mean heart rates and their difference of paired intervals."""
    d = (F.col(test) - F.col(ref)) * 1000
    g = pairs.groupBy(*keys).agg(
        F.count("*").alias("n_common"), F.avg(F.abs(d)).alias("rr_mae_ms"), F.sqrt(F.avg(d * d)).alias("rr_rmse_ms"), correlation(ref, test).alias("rr_corr"),
        (60 / F.avg(ref)).alias("mean_hr_ref"), (60 / F.avg(test)).alias("mean_hr_test"),
    )
    return g.withColumn("mean_hr_diff", F.col("mean_hr_test") - F.col("mean_hr_ref"))


def error_log(matched: DataFrame, window_s: float, tol: float, with_tp: bool = False) -> DataFrame:
    """Misses and false alarms (and matches) as events, with the index of their window (-1 and below before the start)."""
    t = F.coalesce("t_ref", "t_test")
    out = matched.withColumnRenamed("kind", "error_type").withColumns({"t_s": t, "window_idx": F.floor(t / window_s).cast("bigint"), "tol_s": F.lit(tol), "dt_ms": (F.col("t_test") - F.col("t_ref")) * 1000})
    return (out if with_tp else out.where("error_type <> 'TP'")).drop("t_ref", "t_test")


def first_common(ref: DataFrame, test: DataFrame, keys: Keys, t: str, most: float = 0.2) -> DataFrame:
    """The first pair of events within `most`: where two trains are anchored."""
    return band_match(ref, test, keys, t, most).groupBy(*keys).agg(F.min(F.struct("t_ref", "t_test")).alias("p")).select(*keys, "p.t_ref", "p.t_test")


def nearest_shift(near: DataFrame, keys: Keys, most: float = 1.0) -> DataFrame:
    """Median signed distance to the nearest event, of those within `most`."""
    return near.where(F.abs("dt") <= most).groupBy(*keys).agg(F.median("dt").alias("delta"), F.count("*").alias("n"))


def refined_shift(matched: DataFrame, keys: Keys, limit: float = 0.2, least: int = 10) -> DataFrame:
    """The median dt of matches within ±limit; 0 with fewer than `least`."""
    g = matched.where("kind = 'TP'").groupBy(*keys).agg(F.median(F.col("t_test") - F.col("t_ref")).alias("m"), F.count("*").alias("n"))
    return g.select(*keys, F.when(F.col("n") >= least, F.greatest(F.least("m", F.lit(limit)), F.lit(-limit))).otherwise(0.0).alias("delta"))


def minute_scores(matched: DataFrame, keys: Keys, step: float = 60.0) -> DataFrame:
    """Rates by bin of time."""
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    g = matched.withColumn("bin", F.floor(F.coalesce("t_ref", "t_test") / step).cast("bigint")).groupBy(*keys, "bin").agg(n("TP").alias("tp"), n("FN").alias("fn"), n("FP").alias("fp"))
    return with_rates(g)


def tolerance_sweep(ref: DataFrame, test: DataFrame, keys: Keys, t: str, tolerances: list[float]) -> DataFrame:
    """Match metrics at each tolerance, all in one plan."""
    return metrics(greedy_match(ref, test, keys, t, tolerances), [*keys, "tol_s"])


def ranked(metrics: DataFrame, variants: Keys, keys: Keys | None = None, by: str = "f1") -> DataFrame:
    """Variants (of detectors, cleaning, tolerances) from the best to the worst, among `keys`; those without a score last, ties by name."""
    best = W.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc_nulls_last(by), *variants)
    return metrics.withColumn("rank", F.row_number().over(best))


def pooled(metrics: DataFrame, variants: Keys) -> DataFrame:
    """Counts summed over recordings, with the rates that they give."""
    return with_rates(metrics.groupBy(*variants).agg(*(F.sum(c).alias(c) for c in ("tp", "fn", "fp"))))

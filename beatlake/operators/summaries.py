"""Study summaries: counts, quantiles, pivots and comparisons."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beatlake.functions.scalars import correlation
from beatlake.operators.quantiles import quantiles, same, with_quantiles

Keys = list[str]


def patient_summary(recordings: DataFrame, events: DataFrame, patient: str, recording: str, duration: str) -> DataFrame:
    """Recordings, hours, events (0 without) and hours an event of each patient."""
    r = recordings.groupBy(patient).agg(F.countDistinct(recording).alias("n_recordings"), (F.sum(duration) / 3600.0).alias("hours"))
    e = events.groupBy(patient).agg(F.count("*").alias("n_events"))
    x = r.join(e, patient, "left").na.fill(0, ["n_events"])
    return x.withColumn("hours_per_event", F.col("hours") / F.nullif(F.col("n_events"), F.lit(0)))


def overview(values: DataFrame, metrics: dict[str, Column], exact: dict[str, tuple[Column | str, float]] | None = None) -> DataFrame:
    """One aggregation turned into metric/value rows, with exact quantiles among them."""
    one = values.agg(*(c.cast("double").alias(m) for m, c in metrics.items()))
    if exact:
        one, metrics = with_quantiles(one, values, [], exact), [*metrics, *exact]
    return one.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))).alias("r")).select("r.*")


def describe(df: DataFrame, keys: Keys, col: str, qs: list[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """count, mean, std, min, exact quantiles, max."""
    x = df.groupBy(*keys).agg(F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max"))
    names = {f"p{round(q * 1000):03d}": (col, float(q)) for q in qs}
    return with_quantiles(x, df, keys, names).select(*keys, "count", "mean", "std", "min", *names, "max")


def group_summary(df: DataFrame, keys: Keys, cols: list[str]) -> DataFrame:
    """mean, std, median and count of several columns, by flat names."""
    g = df.groupBy(*keys).agg(*(f(c).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("count", F.count))))
    return with_quantiles(g, df, keys, {f"{c}_median": (c, 0.5) for c in cols})


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    """Counts of values, null among them."""
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, a: str, b: str, values: list) -> DataFrame:
    """Counts of b's values by a, 0 where none."""
    x = df.groupBy(a).pivot(b, values).agg(F.count(F.lit(1)))
    return x.select(a, *(F.coalesce(F.col(str(v).lower() if isinstance(v, bool) else str(v)), F.lit(0)).alias(f"n_{str(v).lower()}") for v in values))


def pivot_mean(df: DataFrame, index: Keys, columns: str, value: str, names: list[str]) -> DataFrame:
    """Mean by index with a column for each name, in this order."""
    return df.groupBy(*index).pivot(columns, names).agg(F.avg(value))


def unstack_median(df: DataFrame, index: Keys, columns: str, value: str, names: list[str]) -> DataFrame:
    return df.groupBy(*index).pivot(columns, names).agg(F.median(value))


def stack(df: DataFrame, index: Keys, names: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(index, names, name, value)


def paired_delta(df: DataFrame, index: Keys, method: str, value: str, base: str, others: list[str]) -> DataFrame:
    """Each other method's mean less that of the base, on rows of the index that have both."""
    x = pivot_mean(df, index, method, value, [base, *others])
    long = x.select(*index, F.explode(F.array(*(F.struct(F.lit(o).alias("method"), (F.col(o) - F.col(base)).alias("delta")) for o in others))).alias("r")).select(*index, "r.*")
    return long.where("delta is not null")


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Correlation of each pair of columns."""
    one = df.agg(*(correlation(a, b).alias(f"{a}__{b}") for a, b in combinations(cols, 2)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("r")) for a, b in combinations(cols, 2)))
    return one.select(F.explode(rows).alias("x")).select("x.*")


def histogram(df: DataFrame, keys: Keys, value: Column, bins: int, low: float, high: float) -> DataFrame:
    """Counts and percentages of equal bins between low and high; other values go."""
    x = df.withColumn("bin", F.floor((value - low) / ((high - low) / bins)).cast("int")).where((F.col("bin") >= 0) & (F.col("bin") < bins))
    g = x.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    return g.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy(*(keys or [F.lit(0)]))))


def spine_counts(df: DataFrame, spine: DataFrame, keys: Keys) -> DataFrame:
    """Counts by key, 0 for keys of the spine that have none."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return spine.join(n, keys, "left").na.fill(0, ["n"])


def class_summary(df: DataFrame, keys: Keys, label: str, classes: list, cols: list[str]) -> DataFrame:
    """Medians and counts by class; every class has a row for each key, with nulls and 0 where it lacks."""
    spine = df.select(*keys).distinct().withColumn(label, F.explode(F.array(*(F.lit(c) for c in classes))))
    g = with_quantiles(df.groupBy(*keys, label).agg(F.count("*").alias("n")), df, [*keys, label], {c: (c, 0.5) for c in cols}).select(*keys, label, *cols, "n")
    return spine.join(g, [*keys, label], "left").na.fill(0, ["n"])


def quantile_bins(df: DataFrame, keys: Keys, col: str, parts: int = 3, out: str = "bin") -> DataFrame:
    """Bins by exact quantiles (1 is lowest; right ends included); equal cut points merge."""
    names = {f"_q{i}": (col, i / parts) for i in range(1, parts)}
    cuts = quantiles(df, keys, names)
    if keys:
        one = df.alias("a").join(cuts.alias("b"), same("a", "b", keys)).select("a.*", *names)
    else:
        one = df.withColumns({n: F.lit(v).cast("double") for n, v in cuts.first().asDict().items()})
    return one.withColumn(out, F.when(F.col(col).isNotNull(), 1 + F.size(F.filter(F.array_distinct(F.array(*names)), lambda c: F.col(col) > c)))).drop(*names)


#: A window's first rows up to this number are cut in each task before rows are exchanged (Spark's limit of ranks pushed down).
PUSHED = 1000


def top_n(df: DataFrame, keys: Keys, order: list[Column], n: int, parts: int = 64) -> DataFrame:
    """The first n of each group in an order that has no ties; the whole table's, without keys.

    Each task keeps its n best of a group, and only these meet. Above
    `PUSHED` rows, where Spark doesn't do so by itself, a group is dealt by a
    hash to `parts` that keep their n best first.
    """
    if not keys:
        return df.orderBy(*order).limit(n)
    x = df
    if n > PUSHED:
        part = F.pmod(F.xxhash64(*df.columns), F.lit(parts))
        x = df.withColumn("_part", part).withColumn("_rank", F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order))).where(F.col("_rank") <= n).drop("_part", "_rank")
    return x.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def arg_best(df: DataFrame, keys: Keys, col: str, tie: str, take: list[str], smallest: bool = False) -> DataFrame:
    """The row of each group with the largest (smallest) value; of equals, the smallest tie."""
    v = F.col(col) if smallest else -F.col(col)
    best = df.groupBy(*keys).agg(F.min(F.struct(v.alias("_v"), F.col(tie), *(F.col(c) for c in take if c != tie), F.col(col).alias("_x"))).alias("b"))
    return best.select(*keys, F.col(f"b.{tie}").alias(tie), *(F.col(f"b.{c}").alias(c) for c in take if c != tie), F.col("b._x").alias(col))


def sample_n(df: DataFrame, keys: Keys, ident: Column, seed: str, n: int) -> DataFrame:
    """n rows of each group without replacement, by a seeded hash: the same in any run."""
    h = F.md5(F.concat_ws(":", F.lit(seed), ident.cast("string")))
    return df.withColumn("_h", h).withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy("_h"))).where(F.col("_rn") <= n).drop("_h", "_rn")


def robust_minmax(df: DataFrame, keys: Keys, col: str, out: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Values scaled by two quantiles of their group and clipped to 0 and 1."""
    q = quantiles(df, keys, {"_q0": (col, low), "_q1": (col, high)})
    width = F.col("_q1") - F.col("_q0")
    scaled = F.when(width > 0, (F.col(col) - F.col("_q0")) / width)
    return df.join(q, keys).withColumn(out, F.greatest(F.least(scaled, F.lit(1.0)), F.lit(0.0))).drop("_q0", "_q1")


def rank_of(col: str, order: list[str]) -> Column:
    """The place of a category in an explicit order."""
    return F.array_position(F.array(*(F.lit(x) for x in order)), F.col(col))


def confusion(df: DataFrame, truth: str, pred: str, classes: list) -> DataFrame:
    """Counts of predictions by true class, each class a row and a column."""
    x = df.groupBy(truth).pivot(pred, classes).agg(F.count(F.lit(1)))
    spine = df.sparkSession.range(1).select(F.explode(F.array(*(F.lit(c) for c in classes))).alias(truth))
    return spine.join(x, truth, "left").na.fill(0)


def class_scores(df: DataFrame, truth: str, pred: str, classes: list) -> DataFrame:
    """Precision, recall and F1 of each class (0 where undefined)."""
    spine = F.array(*(F.lit(c) for c in classes))
    x = df.withColumn("class", F.explode(spine))
    n = lambda cond: F.count(F.when(cond, 1))
    is_t, is_p = F.col(truth) == F.col("class"), F.col(pred) == F.col("class")
    g = x.groupBy("class").agg(n(is_t & is_p).alias("tp"), n(is_p & ~is_t).alias("fp"), n(is_t & ~is_p).alias("fn"))
    tp = F.col("tp")
    return g.withColumns({"precision": F.coalesce(tp / F.nullif(tp + F.col("fp"), F.lit(0)), F.lit(0.0)), "recall": F.coalesce(tp / F.nullif(tp + F.col("fn"), F.lit(0)), F.lit(0.0)), "f1": F.coalesce(2 * tp / F.nullif(2 * tp + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))})


def predicted(score: Column, t1: Column, t2: Column, higher_is_better: bool = True) -> Column:
    """Class 1, 2 or 3 by two cut points; 3 without a score."""
    passes = (lambda t: score >= t) if higher_is_better else (lambda t: score <= t)
    return F.when(passes(t1), 1).when(passes(t2), 2).otherwise(3)


def macro_f1(counts: dict[tuple[int, int], Column]) -> Column:
    """Mean F1 over three classes from counts by (true class, predicted class); true class 0 stands for any other."""
    total = lambda keep: sum((v for k, v in counts.items() if keep(k)), F.lit(0))
    each = [2 * counts[c, c] / F.greatest(total(lambda k: k[0] == c) + total(lambda k: k[1] == c), F.lit(1)) for c in (1, 2, 3)]  # noqa: B023
    return (each[0] + each[1] + each[2]) / 3


def known_class(truth: str) -> Column:
    return F.when(F.col(truth).isin(1, 2, 3), F.col(truth)).otherwise(0).cast("int")


def fit_two_cuts(df: DataFrame, score: str, truth: str, cuts: list[float], higher_is_better: bool = True) -> DataFrame:
    """The pair of cut points with the best macro F1 over three classes; ties to the first pair.

    Rows are counted once, by class and by how many cuts their score passes.
    From these few counts follow the cumulative counts at each cut, and from
    two of those any pair's confusion matrix; no row meets a pair.
    """
    s, ordered = F.col(score), sorted(set(map(float, cuts)), reverse=not higher_is_better)
    passed = F.size(F.filter(F.array(*map(F.lit, ordered)), lambda c: (s >= c) if higher_is_better else (s <= c)))
    counts = df.select(known_class(truth).alias("_c"), F.coalesce(passed, F.lit(0)).alias("_b")).groupBy("_c", "_b").agg(F.count("*").alias("_n"))
    # rows that pass cut number k (from 1) at least; 0: all rows
    at = counts.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_b")))).groupBy("_k").agg(*(F.sum(F.when(F.col("_c") == c, F.col("_n")).otherwise(0)).alias(f"_p{c}") for c in range(4)))
    pairs = [(i, float(a), float(b)) for i, (a, b) in enumerate((a, b) for a in cuts for b in cuts if (a > b if higher_is_better else a < b))]
    spine = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(a).alias("t1"), F.lit(b).alias("t2"), F.lit(ordered.index(a) + 1).alias("k1"), F.lit(ordered.index(b) + 1).alias("k2")) for i, a, b in pairs))
    x = df.sparkSession.range(1).select(F.explode(spine).alias("g")).select("g.*", F.lit(0).alias("k0"))
    for k in ("k0", "k1", "k2"):
        x = x.join(at.select(F.col("_k").alias(k), *(F.col(f"_p{c}").alias(f"{k}_{c}") for c in range(4))), k, "left")
    n = lambda k, c: F.coalesce(F.col(f"k{k}_{c}"), F.lit(0))
    matrix = {(c, p): v for c in range(4) for p, v in ((1, n(1, c)), (2, n(2, c) - n(1, c)), (3, n(0, c) - n(2, c)))}
    return x.withColumn("macro_f1", macro_f1(matrix)).orderBy(F.desc(F.round("macro_f1", 9)), "rank").limit(1).select("t1", "t2", "macro_f1")


def score_cuts(df: DataFrame, score: str, truth: str, cuts: DataFrame, higher_is_better: bool = True) -> DataFrame:
    """The one row of `cuts` (t1, t2) with the macro F1 that they reach on `df`, and its rows."""
    x = df.select(score, known_class(truth).alias("_c"), F.lit(1).alias("_one")).join(cuts.select("t1", "t2", F.lit(1).alias("_one")), "_one")
    p = predicted(F.col(score), F.col("t1"), F.col("t2"), higher_is_better)
    g = x.groupBy("t1", "t2").agg(F.count("*").alias("n"), *(F.count(F.when((F.col("_c") == c) & (p == q), 1)).alias(f"_{c}{q}") for c in range(4) for q in (1, 2, 3)))
    return g.select("t1", "t2", "n", macro_f1({(c, q): F.col(f"_{c}{q}") for c in range(4) for q in (1, 2, 3)}).alias("macro_f1"))


def hash_place(ident: Column, seed: str) -> Column:
    """A number from 0 to 2^48 by a seeded hash of a row's name, exact in a double."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), ident.cast("string")).cast("binary")), 1, 12), 16, 10).cast("double")


def stratified_split(df: DataFrame, label: str, ident: Column, seed: str, share: float = 0.8, out: str = "is_train") -> DataFrame:
    """`df` with whether a row is of the training part: in each class the `share` of rows with the least hashes, the same in any run.

    Classes are few and their rows many: the cuts, a row a class, go to the rows, which aren't exchanged by class.
    """
    x = df.withColumn("_h", hash_place(ident, seed))
    cut = quantiles(x, [label], {"_cut": ("_h", share)})
    return x.alias("a").join(F.broadcast(cut).alias("b"), same("a", "b", [label])).select(*(F.col(f"a.{c}").alias(c) for c in df.columns), (F.col("a._h") <= F.col("b._cut")).alias(out))


def fit_and_test(df: DataFrame, score: str, truth: str, ident: Column, cuts: list[float], seed: str, share: float = 0.8, higher_is_better: bool = True) -> DataFrame:
    """Cut points fitted on the training part of a stratified split, with the macro F1 there and on the rest."""
    x = stratified_split(df, truth, ident, seed, share)
    best = fit_two_cuts(x.where("is_train"), score, truth, cuts, higher_is_better)
    rest = score_cuts(x.where("not is_train"), score, truth, best, higher_is_better)
    both = best.withColumnRenamed("macro_f1", "train_macro_f1").withColumn("_one", F.lit(1))
    return both.join(rest.select("n", F.col("macro_f1").alias("test_macro_f1"), F.lit(1).alias("_one")), "_one", "left").select("t1", "t2", "train_macro_f1", F.coalesce("n", F.lit(0)).alias("n_test"), "test_macro_f1")

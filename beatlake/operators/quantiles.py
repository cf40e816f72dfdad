"""Exact quantiles of few large groups, by distributed selection.

`percentile` holds every value of a group in one task, which is right where no
group has more than `SMALL` values. A larger group is narrowed first: a histogram of its range, merged
map-side, tells in which bin the wanted rank falls; the next pass looks at
that bin's values alone, until it holds `SMALL` values at most, or equal ones
only. Then the few values left are sorted and the rank is read off. A pass
moves bins, not values; bins are cut evenly, by turns on a linear and a
logarithmic scale between the least and the greatest value in them, so any
distribution gets narrow in a few passes. All groups and ranks share a pass.

Ranks are interpolated linearly, as `percentile` does. Nulls don't count; NaN
is greater than all numbers. A group without values gets nulls. Keys may be
null.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatlake.scratch import Scratch

Keys = list[str]
#: Values that are sorted in one task, and bins of a pass.
SMALL, BINS = 500_000, 2048
#: Where NaN and infinite values lie on the scales of the bins, and what makes the logarithm of the least double positive.
NAN, MOST, LEAST = 2000.0, 1.7e308, 745.0


def log_scale(x: Column) -> Column:
    return F.when(F.isnan(x), NAN).when(x == 0, 0.0).otherwise(F.signum(x) * (F.ln(F.least(F.abs(x), F.lit(MOST))) + LEAST))


def bin_of(x: Column, low: Column, high: Column, logarithmic: bool) -> Column:
    """The bin of a value between the least and the greatest one; never falls as values rise."""
    if logarithmic:
        x, low, high = log_scale(x), log_scale(low), log_scale(high)
    else:
        x, low, high = (F.when(F.isnan(v), MOST).otherwise(F.greatest(F.least(v, F.lit(MOST)), F.lit(-MOST))) for v in (x, low, high))
    width = high / BINS - low / BINS  # each is finite, their difference may not be
    return F.when(width > 0, F.least(F.floor((x / BINS - low / BINS) / width * BINS), F.lit(BINS - 1))).otherwise(0).cast("int")


def same(a: str, b: str, columns: Keys) -> Column:
    return functools.reduce(operator.and_, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns))


def quantiles(df: DataFrame, keys: Keys, wanted: dict[str, tuple[Column | str, float]], small: int = SMALL, every: bool = True) -> DataFrame:
    """A row a group (one row, without keys): its keys and, by name, the quantile of a column or expression.

    Groups without any value have no row where `every` is false, which saves a pass over `df`.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "quantiles")
    columns: dict[str, int] = {}
    number = {name: columns.setdefault(str(c), len(columns)) for name, (c, _) in wanted.items()}
    values = list({columns[str(c)]: (F.col(c) if isinstance(c, str) else c) for c, _ in wanted.values()}.values())
    one = [F.struct(F.lit(i).alias("_c"), v.cast("double").alias("_x")) for i, v in enumerate(values)]
    group = [*keys, "_c"]
    rows = scratch.save(df.select(*keys, F.explode(F.array(*one)).alias("_v")).select(*keys, "_v.*").where("_x is not null"))
    spine = F.array(*(F.struct(F.lit(name).alias("_name"), F.lit(number[name]).alias("_c"), F.lit(float(q)).alias("_q")) for name, (_, q) in wanted.items()))
    size = rows.groupBy(*group).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    full = (lambda given: every_group(df, keys, given)) if every else (lambda given: given)
    if (size.agg(F.max("_n").alias("n")).first()["n"] or 0) <= small:
        qs = sorted({float(q) for _, q in wanted.values()})
        each = rows.groupBy(*group).agg(F.percentile("_x", F.array(*map(F.lit, qs))).alias("_p"))
        return full(each.groupBy(*keys).agg(*(F.max(F.when(F.col("_c") == number[n], F.col("_p")[qs.index(float(q))])).alias(n) for n, (_, q) in wanted.items())))
    # an interpolated quantile needs the ranks around its place
    place = F.col("_q") * (F.col("_n") - 1)
    wants = size.withColumn("_w", F.explode(F.filter(spine, lambda s: s["_c"] == F.col("_c")))).select(*group, "_n", "_lo", "_hi", "_w._name", "_w._q")
    asked = scratch.save(wants.withColumns({"_place": place, "_below": F.floor(place), "_above": F.ceil(place)}))
    ranks = asked.select(*group, F.explode(F.array_distinct(F.array("_below", "_above"))).alias("_rank"), "_n", "_lo", "_hi").distinct()
    # how many values lie before the bin, and how many in it
    todo = scratch.save(ranks.withColumn("_before", F.lit(0).cast("bigint")))
    done: list[DataFrame] = []
    inside = [*group, "_lo", "_hi"]
    turn = 0
    while True:
        narrow = (F.col("_n") <= small) | F.col("_lo").eqNullSafe(F.col("_hi"))
        done.append(todo.where(narrow))
        wide = todo.where(~narrow)
        if wide.isEmpty():
            break
        x, y = rows.alias("x"), wide.select(*inside).distinct().alias("y")
        within = same("x", "y", group) & (F.col("x._x") >= F.col("y._lo")) & (F.col("x._x") <= F.col("y._hi"))
        # the ranges of a pass are the same or apart, so a value is in one at most
        held = x.join(y, within).select(*(F.col(f"y.{c}") for c in inside), "_x").withColumn("_bin", bin_of(F.col("_x"), F.col("_lo"), F.col("_hi"), turn % 2 == 1))
        bins = held.groupBy(*inside, "_bin").agg(F.count("*").alias("_m"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
        # at most BINS rows a range
        listed = bins.groupBy(*inside).agg(F.sort_array(F.collect_list(F.struct("_bin", "_m", "_least", "_most"))).alias("_bins"))
        start = F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<struct<_from:bigint,_m:bigint,_least:double,_most:double>>").alias("a"))
        summed = F.aggregate("_bins", start, lambda acc, b: F.struct((acc["s"] + b["_m"]).alias("s"), F.concat(acc["a"], F.array(F.struct(acc["s"].alias("_from"), b["_m"].alias("_m"), b["_least"].alias("_least"), b["_most"].alias("_most")))).alias("a")))["a"]
        a, b = wide.alias("a"), listed.select(*inside, summed.alias("_bins")).alias("b")
        inner = F.col("_rank") - F.col("_before")
        hit = F.filter("b._bins", lambda z: (z["_from"] <= inner) & (inner < z["_from"] + z["_m"]))[0]
        joined = a.join(b, same("a", "b", inside)).select(*(F.col(f"a.{c}").alias(c) for c in (*group, "_rank", "_before")), hit.alias("_hit"))
        todo = scratch.save(joined.select(*group, "_rank", F.col("_hit._m").alias("_n"), F.col("_hit._least").alias("_lo"), F.col("_hit._most").alias("_hi"), (F.col("_before") + F.col("_hit._from")).alias("_before")))
        turn += 1
    left = functools.reduce(DataFrame.unionByName, (d.select(*group, "_rank", "_n", "_lo", "_hi", "_before") for d in done))
    alike = F.col("_lo").eqNullSafe(F.col("_hi"))
    x, y = rows.alias("x"), left.where(~alike).select(*inside).distinct().alias("y")
    within = same("x", "y", group) & (F.col("x._x") >= F.col("y._lo")) & (F.col("x._x") <= F.col("y._hi"))
    few = x.join(y, within).select(*(F.col(f"y.{c}") for c in inside), "_x").groupBy(*inside).agg(F.sort_array(F.collect_list("_x")).alias("_xs"))
    a, b = left.alias("a"), few.alias("b")
    value = F.when(alike, F.col("_lo")).otherwise(F.get("b._xs", (F.col("_rank") - F.col("_before")).cast("int")))
    found = a.join(b, same("a", "b", inside), "left").select(*(F.col(f"a.{c}").alias(c) for c in (*group, "_rank", "_lo", "_hi", "_before")), F.col("b._xs")).select(*group, "_rank", value.alias("_value"))
    a, lo, hi = asked.alias("a"), found.alias("l"), found.alias("h")
    both = a.join(lo, same("a", "l", group) & (F.col("a._below") == F.col("l._rank"))).join(hi, same("a", "h", group) & (F.col("a._above") == F.col("h._rank")))
    between = F.when(F.col("a._below") == F.col("a._above"), F.col("l._value")).otherwise((F.col("a._above") - F.col("a._place")) * F.col("l._value") + (F.col("a._place") - F.col("a._below")) * F.col("h._value"))
    names = both.select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a._name").alias("_name"), between.alias("_value"))
    return full(names.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == n, F.col("_value"))).alias(n) for n in wanted)))


def every_group(df: DataFrame, keys: Keys, given: DataFrame) -> DataFrame:
    """A group without any value has a row too."""
    if not keys:
        return given
    a, b = df.select(*keys).distinct().alias("a"), given.alias("b")
    return a.join(b, same("a", "b", keys), "left").select(*(F.col(f"a.{k}").alias(k) for k in keys), *(F.col(f"b.{n}").alias(n) for n in given.columns if n not in keys))


def with_quantiles(grouped: DataFrame, df: DataFrame, keys: Keys, wanted: dict[str, tuple[Column | str, float]]) -> DataFrame:
    """`grouped` (a row a group of `df`) with columns of quantiles."""
    found = quantiles(df, keys, wanted, every=False)
    if not keys:
        return grouped.withColumn("_one", F.lit(1)).join(found.withColumn("_one", F.lit(1)), "_one").drop("_one")
    a, b = grouped.alias("a"), found.alias("b")
    return a.join(b, same("a", "b", keys), "left").select("a.*", *(F.col(f"b.{n}").alias(n) for n in wanted))

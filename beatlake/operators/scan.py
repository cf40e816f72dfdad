"""Running values of long series: blocks of time in many tasks, joined by what each carries on.

A window over a whole recording puts it into one task. Here a recording is
cut into blocks of time: each block is worked on by itself, a row a block
says what later (or earlier) blocks need of it, a window over these few rows
adds them up, and each block's rows get what is carried to them. The rows are
exchanged once, by recording and block; summaries merge before they are.

`block` is a length in the unit of time. None leaves recordings whole: one
exchange and no carrying, right where none has more rows than a task should
hold. Rows whose time is null come in a block before all others. A recording
is named by keys that aren't null; rows with a null key are kept, but carry
nothing from block to block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Keys = list[str]
#: The block of rows without a time.
NO_TIME = -(1 << 62)


def blocked(rows: DataFrame, t: str, block: float | None) -> DataFrame:
    """`rows` with `_block`, the number of their block of time."""
    if block is not None and block <= 0:
        raise ValueError("a block has a positive length")
    number = F.lit(0) if block is None else F.coalesce(F.floor(F.col(t) / block), F.lit(NO_TIME))
    return rows.withColumn("_block", number.cast("bigint"))


def within(keys: Keys) -> WindowSpec:
    return W.partitionBy(*keys, "_block")


def earlier(keys: Keys) -> WindowSpec:
    """All blocks of a recording before one."""
    return W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)


def later(keys: Keys) -> WindowSpec:
    """All blocks of a recording after one, as a running frame from the end."""
    return W.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)


def carried(rows: DataFrame, keys: Keys, summary: list[Column], step: Callable[[DataFrame], DataFrame], block: float | None, out: list[str]) -> DataFrame:
    """`rows` with columns `out` that `step` makes of a row a block (`summary`); nulls where recordings are whole."""
    if block is None:
        made = step(rows.groupBy(*keys, "_block").agg(*summary)).select(*out)
        return rows.withColumns({c: F.lit(None).cast(made.schema[c].dataType) for c in out})
    return rows.join(step(rows.groupBy(*keys, "_block").agg(*summary)).select(*keys, "_block", *out), [*keys, "_block"], "left")


def running_sums(rows: DataFrame, keys: Keys, order: list[Column | str], values: dict[str, Column], block: float | None) -> DataFrame:
    """`rows` (blocked) with sums up to each, in the given order, by name."""
    x = rows.withColumns({f"_x{i}": v for i, v in enumerate(values.values())})
    before = [f"_b{i}" for i in range(len(values))]
    step = lambda s: s.withColumns({b: F.sum(f"_y{i}").over(earlier(keys)) for i, b in enumerate(before)})
    x = carried(x, keys, [F.sum(f"_x{i}").alias(f"_y{i}") for i in range(len(values))], step, block, before)
    w = within(keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return x.withColumns({name: F.sum(f"_x{i}").over(w) + F.coalesce(f"_b{i}", F.lit(0)) for i, name in enumerate(values)}).drop(*before, *(f"_x{i}" for i in range(len(values))))


def lagged(rows: DataFrame, keys: Keys, order: list[str], t: str, value: str, block: float | None, out: str) -> DataFrame:
    """`rows` with the value of the row before in the given order, which begins with the time."""
    x = blocked(rows, t, block)
    last = F.max_by(F.struct(value), F.struct(*order)).alias("_last")
    x = carried(x, keys, [last], lambda s: s.withColumn("_far", F.lag("_last").over(W.partitionBy(*keys).orderBy("_block"))), block, ["_far"])
    before = F.lag(F.struct(value)).over(within(keys).orderBy(*order))
    return x.withColumn(out, F.coalesce(before, "_far")[value]).drop("_far", "_block")


def numbered(rows: DataFrame, order: list[Column | str], out: str, first: int = 0) -> DataFrame:
    """`rows` numbered in one order of all, without a task that holds them: sorted ranges count on from the rows of the ranges before."""
    from beatlake.scratch import Scratch

    # a row's number within its range is the lower part of the id
    ids = F.monotonically_increasing_id()
    x = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", ids)
    x = Scratch(rows.sparkSession, "numbered").save(x).withColumn("_range", F.shiftright("_id", 33))
    # a row a range: a few numbers, whatever the rows
    sizes = x.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.col("_id").bitwiseAND((1 << 33) - 1) + F.col("_before") + first
    return x.join(sizes.select("_range", before.alias("_before")), "_range").withColumn(out, place.cast("bigint")).drop("_id", "_range", "_before")


def groups_apart(rows: DataFrame, keys: Keys, order: list[str], t: str, gap: float | Column, block: float | None, out: str) -> DataFrame:
    """Numbers runs of rows that are no further apart than `gap` (a number, or a column of the keys): gaps within blocks are counted there, gaps between them on the blocks' ends."""
    w = within(keys).orderBy(t, *order)
    x = blocked(rows, t, block).withColumn("_new", F.when(F.col(t) - F.lag(t).over(w) > gap, 1).otherwise(0))
    inside = F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))
    if block is None:
        return x.withColumn(out, inside).drop("_new", "_block")

    def step(s: DataFrame) -> DataFrame:
        # blocks without a time don't part anything
        before = F.max("_hi").over(earlier(keys))
        s = s.withColumn("_first", F.when(F.col("_lo") - before > gap, 1).otherwise(0))
        return s.withColumn("_base", F.col("_first") + F.coalesce(F.sum(F.col("_n") + F.col("_first")).over(earlier(keys)), F.lit(0)))

    x = carried(x, keys, [F.sum("_new").alias("_n"), F.min(t).alias("_lo"), F.max(t).alias("_hi")], step, block, ["_base"])
    return x.withColumn(out, inside + F.coalesce("_base", F.lit(0))).drop("_new", "_base", "_block")


def stream(rows: DataFrame, columns: list[str], order: list[str], by: list[str], schema: T.StructType, make: Callable[[], Callable]) -> DataFrame:
    """One pass over rows that are dealt by `by` and sorted by `order`; `make()` gives a function from a batch's columns (lists) to output tuples, called with None at the end."""
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), target.types)], schema=target)

        for batch in batches:
            if found := call([c.to_pylist() for c in batch.columns]):
                yield batch_of(found)
        if found := call(None):
            yield batch_of(found)

    return rows.select(*columns).repartition(*by).sortWithinPartitions(*order).mapInArrow(run, schema)


def jumps(times: np.ndarray, hold: float) -> np.ndarray:
    """For each of some ascending, different times, the first that is `hold` later; their number where there is none."""
    n = len(times)
    to = np.searchsorted(times, times + hold)
    # the sum is rounded where the difference below isn't
    back = np.maximum(to - 1, 0)
    to = np.where((to > 0) & (times[back] - times >= hold), back, to)
    at = np.minimum(to, n - 1)
    return np.where((to < n) & (times[at] - times < hold), to + 1, to)


def leaving(times: np.ndarray, hold: float) -> tuple[list[float], list[float]]:
    """What a block makes of the time kept last before it: (upto, leave), where the first `upto` that is `hold` later names the time kept last within it.

    Pointers from each time to the next one kept are doubled until all point
    at the end of their chain. The state before a block is earlier than its
    first time, so a chain begins at the latest with the first time that is
    `hold` after that.
    """
    times = np.unique(times)
    if len(times) == 1:
        return times.tolist(), times.tolist()
    to = jumps(times, hold)
    last = np.where(to < len(times), to, np.arange(len(times)))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    first = min(int(to[0]), len(times) - 1) + 1
    ends = last[:first]
    cut = np.append(np.flatnonzero(np.diff(ends)), first - 1)
    return times[cut].tolist(), times[ends[cut]].tolist()


def kept_apart(rows: DataFrame, keys: Keys, t: str, hold: float, block: float | None) -> DataFrame:
    """Times that are at least `hold` after the last one kept, from the first on.

    Sequential, but a block only needs the time kept last before it. Each
    block sums up what it makes of any such time (`leaving`), a pass over a
    recording's blocks follows these, and then all blocks keep theirs.
    """
    given = blocked(rows.select(*keys, F.col(t).cast("double").alias(t)).where(F.col(t).isNotNull()), t, block)
    n = len(keys)
    names = [given.schema[k] for k in keys]
    number, state = T.StructField("_block", T.LongType()), T.StructField("_last", T.DoubleType())

    def sum_up():
        now, times = None, []

        def call(columns):
            nonlocal now, times
            out = []
            for key, x in zip(zip(*columns[: n + 1]), columns[n + 1]) if columns else [(None, None)]:
                if key != now:
                    if times:
                        out.append((*now, *leaving(np.array(times), hold)))
                    now, times = key, []
                times.append(x)
            return out

        return call

    def follow():
        now, last = None, -np.inf

        def call(columns):
            nonlocal now, last
            out = []
            for *key, block, upto, leave in zip(*columns) if columns else ():
                if key != now:
                    now, last = key, -np.inf
                out.append((*key, block, last))
                last = next((to for u, to in zip(upto, leave) if u - last >= hold), last)
            return out

        return call

    def keep():
        now, last = None, -np.inf

        def call(columns):
            nonlocal now, last
            out = []
            for key, x, before in zip(zip(*columns[: n + 1]), columns[n + 1], columns[n + 2]) if columns else ():
                if key != now:
                    now, last = key, -np.inf if before is None else before
                if x - last >= hold:
                    last = x
                    out.append((*key[:n], x))
            return out

        return call

    if block is None:
        rows_in = given.withColumn("_last", F.lit(None).cast("double"))
    else:
        arrays = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("upto", "leave")]
        made = stream(given, [*keys, "_block", t], [*keys, "_block", t], [*keys, "_block"], T.StructType([*names, number, *arrays]), sum_up)
        states = stream(made, [*keys, "_block", "upto", "leave"], [*keys, "_block"], keys, T.StructType([*names, number, state]), follow)
        rows_in = given.join(states, [*keys, "_block"], "left")
    return stream(rows_in, [*keys, "_block", t, "_last"], [*keys, "_block", t], [*keys, "_block"], T.StructType([*names, given.schema[t]]), keep)

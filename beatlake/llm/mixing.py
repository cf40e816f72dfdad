"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate, its share of the target mass over
its mass. A document's count inverts the Poisson distribution at a uniform
number that hashes from seed and doc_id, so it is the same in any run and
order. Documents are exploded by their count and dealt over all partitions by
a hash of (seed, doc_id, copy), then ordered by it within them: a global
shuffle. Rates are one row for each named weight and one for the rest, a
bound that the caller sets; so they may be broadcast, and a source with a
third of all rows is never gathered in one task.

All of it is DataFrame functions. The distribution is tabled once for each
rate; a document counts the entries at or below its number. A rate above
`DRAW_RATE` is the sum of several such draws of equal means, so exp(-rate)
never underflows and no target is cut, whatever the rate.

Defined results: sources that `weights` doesn't name (null too) share
`other`, in proportion to their mass. Null or empty texts have no mass but
repeat like their source. Repeated rows repeat alike. A source without mass
has rate 0. Copies of a null doc_id hash from an empty string. An empty table
gives none. Of an input column named rate, copies, copy_no or mix_key, `mix`
returns its own and `repeat` the input's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beatlake.llm.common import boxed, require, unboxed

SEED = "mix-1"
#: Weights in the registered query; other sources share the rest.
WEIGHTS = {"src0": 0.20, "src1": 0.10, "src2": 0.10, "src3": 0.05, "src4": 0.05}
OTHER = 0.50
TARGET = 1.0
#: The most weights (more is an error), and the largest mean of one Poisson draw.
MAX_WEIGHTS, DRAW_RATE = 10_000, 256.0
#: What `mix` adds.
OWN = ("rate", "copies", "copy_no", "mix_key")
# Two digits of hexadecimal short of a double's precision.
DIGITS = 12


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def poisson_table(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, ... at a mean of `rate`, up to ten deviations beyond it."""
    top = (F.ceil(rate + 10 * F.sqrt(rate)) + 20).cast("int")
    return F.aggregate(
        F.sequence(F.lit(1), top),
        F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf")),
        lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * rate / k)).alias("cdf")),
        lambda acc: acc["cdf"],
    )


def rates(docs: DataFrame, weights: dict[str, float], other: float, target: float) -> DataFrame:
    """mix_source (null: the rest), mass, rate: one row for each named source that occurs, and for the rest."""
    if len(weights) > MAX_WEIGHTS:
        raise ValueError(f"more than {MAX_WEIGHTS} weights")
    names = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)) if weights else F.create_map().cast("map<string,double>")
    total = float(sum(weights.values()) + other)
    mass = docs.groupBy(mix_source(weights).alias("mix_source")).agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("mass"))
    share = F.coalesce(F.element_at(names, F.col("mix_source")), F.lit(float(other))) / total
    rate = F.when(F.col("mass") > 0, share * float(target) * F.sum("mass").over(W.partitionBy(F.lit(0))) / F.col("mass")).otherwise(0.0)
    # the window is over these few rows
    return mass.select("mix_source", "mass", rate.alias("rate"))


def mix_source(weights: dict[str, float]) -> Column:
    return F.when(F.col("source").isin(*weights), F.col("source")) if weights else F.lit(None).cast("string")


def dealt(docs: DataFrame, weights: dict[str, float], other: float, target: float, seed: str) -> DataFrame:
    """`row` (the struct of a document) once for each copy, with the columns of `OWN`, shuffled."""
    require(docs, "doc_id", "text", "source")
    draws = F.greatest(F.ceil(F.col("rate") / DRAW_RATE), F.lit(1)).cast("int")
    table = rates(docs, weights, other, target).select("mix_source", "rate", draws.alias("draws"), poisson_table(F.col("rate") / draws).alias("cdf"))
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # `table` has a row for each weight and one more, so it may be broadcast
    rows = boxed(docs, mix_source(weights).alias("own_source"), ident.alias("ident")).join(F.broadcast(table), F.col("own_source").eqNullSafe(F.col("mix_source")))
    drawn = lambda u: F.size(F.filter("cdf", lambda x: x <= u))
    first = drawn(uniform(F.lit(seed), F.col("ident")))
    more = F.aggregate(F.sequence(F.lit(1), F.col("draws") - 1), F.lit(0), lambda acc, j: acc + drawn(uniform(F.lit(seed), F.col("ident"), F.lit("draw"), j.cast("string"))))
    copies = F.when(F.col("draws") == 1, first).otherwise(first + more)
    counted = rows.select("row", "ident", "rate", copies.alias("copies")).where("copies > 0")
    out = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    out = out.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(seed), "ident", F.col("copy_no").cast("string"))))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.select("row", *OWN).repartition(n, "mix_key").sortWithinPartitions("mix_key")


def mix(docs: DataFrame, weights: dict[str, float] = WEIGHTS, other: float = OTHER, target: float = TARGET, seed: str = SEED) -> DataFrame:
    """`docs` repeated to the weights and shuffled, with rate, copies, copy_no (from 0) and mix_key."""
    return dealt(docs, weights, other, target, seed).select(*unboxed(docs.columns, OWN), *OWN)


def repeat(docs: DataFrame, weights: dict[str, float] = WEIGHTS, other: float = OTHER, target: float = TARGET, seed: str = SEED) -> DataFrame:
    """The same rows with the columns of `docs` alone."""
    return dealt(docs, weights, other, target, seed).select(*unboxed(docs.columns))

"""Scores and overlaps whose cost follows the number of intervals."""

import random
import re

import pytest
from pyspark.sql import functions as F

from beatlake.operators import intervals as I
from beatlake.operators import scoring as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def intervals(n, seed):
    rnd = random.Random(seed)
    return [(g, r, a, a + rnd.choice([0, 1, 3, 40])) for g, r, a in ((rnd.choice("yn"), rnd.randrange(3), rnd.randrange(300)) for _ in range(n))]


@pytest.mark.parametrize("block", [None, 25.0])
def test_score_like_brute_force(spark, block):
    # a recording is in one group only
    found, true = ({("y" if r else "n", r, float(a), float(b)) for _, r, a, b in intervals(n, s)} for n, s in ((60, 1), (25, 2)))
    schema = "g string, r int, a double, b double"
    x, y = spark.createDataFrame([*found, *list(found)[:5]], schema), spark.createDataFrame(sorted(true), schema)
    hours = spark.createDataFrame([(2.0,)], "hours double")
    got = {r["g"]: (r["n_events"], r["n_true"], r["n_detected"], r["n_false"]) for r in S.score(x, y, "r", ("a", "b"), ("a", "b"), 2.0, hours, ["g"], "g", block).collect()}
    meet = lambda f, e: f[1] == e[1] and f[2] <= e[3] + 2 and f[3] >= e[2] - 2
    want = {}
    for g in ("y", "n", "all"):
        fs, es = ([v for v in s if g in (v[0], "all")] for s in (found, true))
        want[g] = (len(fs), len(es), sum(any(meet(f, e) for f in fs) for e in es), sum(not any(meet(f, e) for e in es) for f in fs))
    assert got == want and 0 < want["all"][3] < want["all"][0] and 0 < want["all"][2] <= want["all"][1]


def test_score_reads_each_side_once_and_makes_no_pairs(spark):
    x = spark.range(50).select(F.lit(1).alias("r"), F.col("id").cast("double").alias("a"), (F.col("id") + 0.5).alias("b"))
    hours = spark.createDataFrame([(2.0,)], "hours double")
    p = plan(S.score(x, x, "r", ("a", "b"), ("a", "b"), 1.0, hours))
    assert "Join" not in p and len(re.findall(r"\bRange \(", p)) == 2


def test_sides_that_grow_are_not_broadcast(spark, tmp_path):
    """Files of a few kilobytes, which Spark would send whole to all tasks, however many rows they hold."""
    spark.range(1000).select(F.lit(1).alias("r"), F.col("id").alias("window_idx"), F.col("id").cast("double").alias("a"), (F.col("id") + 1.0).alias("b"), F.lit(True).alias("ok")).write.parquet(f"{tmp_path}/w")
    w = spark.read.parquet(f"{tmp_path}/w")
    assert "BroadcastHashJoin" not in plan(I.floor_window(w.select("r", "a"), w, ["r"], "a", 1.0, ["ok"]))
    assert "BroadcastHashJoin" not in plan(I.overlap_pairs(w, w.select("r", "a", "b"), ["r"], ("a", "b"), ("a", "b")))

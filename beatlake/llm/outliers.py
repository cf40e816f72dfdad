"""Quality rules: base counts, then robust multivariate outliers.

Each text gives a vector of transformed statistics, all of which vary in any
clean text. For every group of documents (language and source), every
language and the whole corpus the minimum covariance determinant is
estimated. Starts are sought on about `SUBSET` rows of each group (those whose
hash is lowest): coordinate-wise medians and `STARTS` small draws take
concentration steps (the `SHARE` nearest to the centre give the next centre
and covariance) until their determinants stand still, and the least one wins.
From it all rows of the group take the same steps, group by group, again until
the determinant stands still; then all rows within a chi-square bound give
the final estimate. Covariances are regularised only against singularity, by
`RIDGE` of the variance over all rows.

An estimate of n rows is shrunk to that above it (a group's to its
language's, that to the corpus's), which counts as `PRIOR` rows; so small
groups lean on their language and no group is left out. A document is
rejected if its squared Mahalanobis distance is above `CUT`.

A step is one grouped aggregation over the statistics table: sums of products
by sixteenths of an octave of the distance, of which those up to the one that
holds the `SHARE`'s row are added up. These are counts and sums, merged
map-side and with no sketch, so a group with a third of all rows is never
gathered, and verdicts don't depend on how rows are dealt. Only starts and the
parameters of groups, a few rows each, are computed in Python.

Defined results: null text counts as empty; null language or source is a
group of its own. Repeated rows return once each; in the estimates rows of the
same language, source and statistics count once, so that many copies of one
text don't make a group look narrow. Documents that
fail the base rules take no part in the estimates and have no distance. An
empty table gives no row. Extra columns of any name are not read.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatlake.llm.common import map_rows, require
from beatlake.scratch import Scratch

WINDOW = 8
MIN_WORDS, MAX_REPEAT = 20, 30
SYMBOL = re.compile(rb"[#*$%&|<>]")
SPLIT = re.compile(rb"[\x20\x09-\x0d]+")

SHARE = 0.75
#: Rows of a group on which starts are sought, draws of `DRAW` rows each, and the fall of a log-determinant that counts as a move.
SUBSET, STARTS, DRAW, STILL = 500, 20, 10, 1e-3
#: Parts of an octave of squared distance that a step tells apart.
PARTS = 16
PRIOR, RIDGE = 100.0, 1e-4
VECTOR = ("log_words", "word_length", "punctuation", "capitals")
# At 4 degrees of freedom the chi-square quantile for 0.975, and the consistency factors of covariances cut at 0.75 and 0.975.
INNER, CONSISTENT, CONSISTENT_INNER = 11.143, 0.75 / 0.5045, 0.975 / 0.9159
# Statistics of short texts have heavier tails than a normal distribution: the 0.999 quantile of squared distances
# under a multivariate t of 8 degrees of freedom, which is 4 times that of F(4, 8).
CUT = 57.57
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
CAPITALS = string.ascii_uppercase.encode()


def repeated_words(words: list[bytes]) -> int:
    """Words covered by windows of `WINDOW` words that are found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    if len(number) == len(words):
        return 0
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    code = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        code = code * np.uint64(0xD6E8FEB86659FD93) + mixed[i : i + n]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def counts(text: bytes | None) -> tuple[int, ...]:
    """`COUNTS` of UTF-8 text."""
    raw = text or b""
    words = raw.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    lines = Counter(line for line in raw.split(b"\n") if line and not line.isspace()) if b"\n" in raw else {}
    marks, capitals = (len(raw) - len(raw.translate(None, c)) for c in (PUNCTUATION, CAPITALS))
    return len(words), chars, len(SYMBOL.findall(raw)), sum(lines.values()) - len(lines), repeated_words(words), marks, capitals


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_punctuation", "n_capitals")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts and base_failed of every row."""
    require(docs, "doc_id", "text", "lang", "source")
    kept = [docs.schema[c] for c in ("doc_id", "lang", "source")]
    schema = T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def make():
        def one(doc_id, lang, source, text):
            yield (doc_id, lang, source, *counts(text))

        return one

    rows = docs.select("doc_id", "lang", "source", F.col("text").cast("binary").alias("raw"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return map_rows(rows, ["doc_id", "lang", "source", "raw"], schema, make).withColumn("base_failed", failed)


def vector() -> list[Column]:
    """The transformed statistics, from the counts; zero words count as one."""
    n = F.greatest("n_words", F.lit(1))
    return [F.log1p(F.col("n_words").cast("double")), F.col("word_chars") / n, F.sqrt(F.col("n_punctuation") / n), F.sqrt(F.col("n_capitals") / n)]


def named(kind: str, *columns: str) -> Column:
    """The name of a group, null values told apart from any other."""
    return F.concat_ws("\x00", F.lit(kind), *(F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in columns))


ALL = "all"
D = len(VECTOR)
ESTIMATE = "g string, n double, m array<double>, c array<double>, w array<double>, logdet double"
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
SUMS = ("n", *(f"s{i}" for i in range(D)), *(f"p{i}{j}" for i, j in PAIRS))


def moments(rows: DataFrame, *keys: str) -> DataFrame:
    """Count, sums and sums of products of x by `keys`."""
    x = [F.col("x")[i] for i in range(D)]
    values = [F.count("*").cast("double"), *map(F.sum, x), *(F.sum(x[i] * x[j]) for i, j in PAIRS)]
    return rows.groupBy(*keys).agg(*(v.alias(name) for v, name in zip(values, SUMS)))


def distance() -> Column:
    """Squared Mahalanobis distance of x under centre m and whitening rows w (the inverse's Cholesky factor, row by row)."""
    diff = [F.col("x")[i] - F.col("m")[i] for i in range(D)]
    rows = [sum((F.col("w")[i * D + j] * diff[j] for j in range(i, D)), F.lit(0.0)) for i in range(D)]
    return sum((r * r for r in rows), F.lit(0.0))


def whitened(c: np.ndarray) -> np.ndarray:
    return np.linalg.cholesky(np.linalg.inv(c)).T


def regular(c: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    c = c + np.diag(ridge)
    # rounding can leave a variance below zero by less than the ridge's share
    return c + np.diag(np.maximum(ridge - np.diag(c), 0.0))


def estimates(sums: DataFrame, factor: float, ridge: np.ndarray) -> DataFrame:
    """Centre, covariance, whitening and log-determinant of each group from its sums; a row a group, in Python where Spark put it."""

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf[["g", *SUMS]].itertuples(index=False):
                n, m = row[1], np.array(row[2 : 2 + D]) / row[1]
                second = np.zeros((D, D))
                for (i, j), v in zip(PAIRS, row[2 + D :]):
                    second[i, j] = second[j, i] = v / n
                c = regular((second - np.outer(m, m)) * factor, ridge)
                out.append((row[0], n, m.tolist(), c.ravel().tolist(), whitened(c).ravel().tolist(), float(np.linalg.slogdet(c)[1])))
            yield pd.DataFrame(out, columns=["g", "n", "m", "c", "w", "logdet"])

    return sums.mapInPandas(run, ESTIMATE)


def start(x: np.ndarray, ridge: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of least determinant among starts on the rows of x, each gone on with until it stands still."""

    def estimate(y: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        m = y.mean(0)
        return m, regular((y - m).T @ (y - m) / len(y) * factor, ridge)

    def settled(m: np.ndarray, c: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        best = (np.inf, m, c)
        while True:
            d = (((x - m) @ whitened(c).T) ** 2).sum(1)
            m, c = estimate(x[np.argsort(d, kind="stable")[: int(np.ceil(SHARE * len(x)))]], CONSISTENT)
            logdet = float(np.linalg.slogdet(c)[1])
            if logdet < best[0]:
                moved, best = best[0] - logdet > STILL, (logdet, m, c)
                if moved:
                    continue
            return best

    low, middle, high = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    starts = [(middle, np.diag(np.maximum((high - low) / 1.349, ridge**0.5) ** 2))]
    draw = np.random.default_rng(seed)
    starts += [estimate(x[draw.choice(len(x), min(DRAW, len(x)), replace=False)], 1.0) for _ in range(STARTS)]
    return min((settled(*s) for s in starts), key=lambda s: s[0])[1:]


def first_estimates(fit: DataFrame, ridge: np.ndarray, scratch: Scratch) -> DataFrame:
    """The best start of each group, on about `SUBSET` rows of it."""
    sizes = scratch.save(fit.groupBy("g").agg(F.count("*").alias("size")))
    u = F.pmod(F.xxhash64("x"), F.lit(1 << 30))
    some = fit.withColumn("u", u).join(sizes, "g").where(F.col("u") < F.lit(float(1 << 30)) * SUBSET / F.col("size")).select("g", "u", "x")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["u"], map(tuple, pdf["x"])))
        g = pdf["g"].iloc[0]
        m, c = start(np.array([x for _, x in rows], float), ridge, zlib.crc32(g.encode()))
        return pd.DataFrame({"g": [g], "n": [float(len(rows))], "m": [m.tolist()], "c": [c.ravel().tolist()], "w": [whitened(c).ravel().tolist()], "logdet": [float("inf")]})

    return scratch.save(some.groupBy("g").applyInPandas(run, ESTIMATE))


def concentrated(fit: DataFrame, now: DataFrame, ridge: np.ndarray) -> DataFrame:
    """One step: the `SHARE` of each group nearest to its centre gives its next estimate."""
    part = F.floor(F.log2(F.greatest(distance(), F.lit(1e-12))) * PARTS)
    by_part = moments(fit.join(now.select("g", "m", "w"), "g").select("g", "x", part.alias("part")), "g", "part")
    whole = Window.partitionBy("g")
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    near = by_part.select("*", before.alias("before"), F.sum("n").over(whole).alias("size")).where(F.col("before") < F.ceil(F.col("size") * SHARE))
    return estimates(near.groupBy("g").agg(*(F.sum(c).alias(c) for c in SUMS)), CONSISTENT, ridge)


def least_determinants(fit: DataFrame, ridge: np.ndarray, scratch: Scratch) -> DataFrame:
    """g, m, w of every group once its determinant stands still; groups that have settled take no further step."""
    moving, settled = first_estimates(fit, ridge, scratch), []
    while True:
        old = moving.select("g", F.struct("logdet", "n", "m", "c", "w").alias("old"))
        both = concentrated(fit, moving, ridge).select("g", F.struct("logdet", "n", "m", "c", "w").alias("new")).join(old, "g")
        fell = F.col("old.logdet") - F.col("new.logdet")
        step = scratch.save(both.select("g", F.when(fell > 0, F.col("new")).otherwise(F.col("old")).alias("best"), (fell > STILL).alias("moves")))
        settled.append(step.where("not moves").select("g", "best.m", "best.w"))
        moving = step.where("moves").select("g", "best.*")
        if moving.isEmpty():
            return scratch.save(reduce(DataFrame.unionByName, settled))


def shrunk(parts: DataFrame, above: tuple[str, ...]) -> DataFrame:
    """g, m, w of each group from its own estimate (columns n, m, c) and those of the levels in `above` (n_l, m_l, c_l), the last one widest."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                m, c = np.array(getattr(r, f"m_{above[-1]}")), np.array(getattr(r, f"c_{above[-1]}"))
                for level in (*reversed(above[:-1]), None):
                    n, own_m, own_c = (getattr(r, k if level is None else f"{k}_{level}") for k in "nmc")
                    m, c = (n * np.array(own_m) + PRIOR * m) / (n + PRIOR), (n * np.array(own_c) + PRIOR * c) / (n + PRIOR)
                out.append((r.g, m.tolist(), whitened(c.reshape(D, D)).ravel().tolist()))
            yield pd.DataFrame(out, columns=["g", "m", "w"])

    return parts.mapInPandas(run, "g string, m array<double>, w array<double>")


def verdicts(spark: SparkSession, stats: DataFrame, cut: float = CUT) -> DataFrame:
    """`stats` with distance (null where the base rules failed) and kept."""
    scratch = Scratch(spark, "outliers")
    rows = scratch.save(stats.select(F.struct(*stats.columns).alias("row"), named("lang", "lang").alias("g1"), named("source", "lang", "source").alias("g2"), F.array(*vector()).alias("x")))
    sound = rows.where("not row.base_failed")
    fit = scratch.save(sound.groupBy("g1", "g2", "x").agg(F.count("*").alias("copies"))).select("x", F.explode(F.array(F.lit(ALL), "g1", "g2")).alias("g"))
    usual = sound.agg(*(F.var_pop(F.col("x")[i]) for i in range(D))).first()
    ridge = np.array([RIDGE * (v or 0.0) + 1e-9 for v in usual])
    now = least_determinants(fit, ridge, scratch)
    inner = fit.join(now, "g").where(distance() <= INNER)
    final = scratch.save(estimates(moments(inner, "g"), CONSISTENT_INNER, ridge))
    level = lambda key, tag: final.select(F.col("g").alias(key), *(F.col(c).alias(f"{c}_{tag}") for c in "nmc"))
    groups = sound.select("g1", F.col("g2").alias("g"), F.lit(ALL).alias("g0")).distinct()
    parts = groups.join(final.select("g", "n", "m", "c"), "g").join(level("g1", "lang"), "g1").join(level("g0", "all"), "g0")
    used = scratch.save(shrunk(parts, ("lang", "all")))
    out = rows.join(used, rows.g2 == used.g, "left").select("row.*", F.when(~F.col("row.base_failed"), distance()).alias("distance"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True)))

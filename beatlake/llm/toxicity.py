"""Toxicity by classifier chains.

Each category has a linear (logistic) model over words and word prefixes that
a text holds, and over those that it holds often (a syllable may stand once in
any clean text, and in every other sentence of a toxic one). The categories stand in a fixed order, and every model also gets
the log-odds that the models before it gave. While training, those log-odds
are out-of-fold, so a later link learns from what an earlier one says about
texts it has not seen.

Categories are label columns, `toxic` last. Where only `toxic` is labelled,
the chain's earlier categories are found in the data: the toxic documents of
the training sample fall into `GROUPS` kinds by the features they share
(cuts along principal directions), and each kind is a category.

Training reads at most `max_train` labelled documents (those whose id hashes
lowest, one row for each id). Features are counted on Spark, and every one
with significant evidence for a category (a log-likelihood ratio of
`min_gain` or more) is kept, so a small language's features don't compete
with a large one's; a feature of one document only tells nothing about
others. Only the selected features of that bounded sample reach the driver.
Scoring is one pass over whole texts without a shuffle.

Defined results: null and empty texts have no feature and get the prior;
without labels, or with labels of one class only, a category's probability
is its smoothed share. Repeated documents score alike; of texts with the same
labelled doc_id the smallest is learned from. Repeated labels of a document
count once, as the largest; null labels don't count. Ids may be of any type.
An empty table gives no row. An input column named like an output (p_...,
is_toxic) gives way to it in `score`; `drop_toxic` returns all columns as
they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatlake.llm.common import keep_rows, map_rows, require
from beatlake.scratch import Scratch

LABEL = "toxic"
#: Kinds of toxic documents where no further category is labelled.
GROUPS = 2
MAX_TRAIN = 20_000
#: Half the chi-square quantile for 0.999 at one degree of freedom.
MIN_GAIN = 5.414
FOLDS = 4
PREFIXES = (4, 5, 6)
#: A word or prefix is frequent in a text that holds it twice, and once in so many words.
OFTEN = 100
THRESHOLD = 0.5

WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Distinct lower-case words, their prefixes marked by a star, and those of both that are frequent, marked by a plus."""
    words = WORD.findall((text or "").lower())
    counts = Counter(words)
    prefixes: Counter[str] = Counter()
    for w, k in counts.items():
        for n in PREFIXES:
            if len(w) > n:
                prefixes[w[:n] + "*"] += k
    counts.update(prefixes)
    return counts.keys() | {f + "+" for f, k in counts.items() if k > 1 and k * OFTEN >= len(words)}


@dataclass(frozen=True)
class Chain:
    categories: tuple[str, ...]
    index: dict[str, int]
    #: A model for each category: weights of the features, then of the earlier log-odds.
    weights: tuple[np.ndarray, ...]
    bias: tuple[float, ...]

    @cached_property
    def heads(self) -> frozenset[str]:
        """The first letters of all known prefixes; few words start with one."""
        return frozenset(f[: PREFIXES[0]] for f in self.index if "*" in f)

    def hits(self, text: str | None) -> list[int]:
        """The known ones of `features`: only words that start like a known prefix are cut into prefixes."""
        words = WORD.findall((text or "").lower())
        counts = Counter(words)
        prefixes: Counter[str] = Counter()
        shortest, heads, index = PREFIXES[0], self.heads, self.index
        for w in [w for w in counts if w[:shortest] in heads]:
            for n in PREFIXES:
                if len(w) > n:
                    prefixes[w[:n] + "*"] += counts[w]
        found = [index[f] for c in (counts, prefixes) for f in index.keys() & c.keys()]
        often = (f + "+" for c in (counts, prefixes) for f, k in c.items() if k > 1 and k * OFTEN >= len(words))
        return sorted(found + [index[f] for f in often if f in index])

    def probabilities(self, text: str | None) -> list[float]:
        hits = self.hits(text) if self.index else []
        odds: list[float] = []
        for w, b in zip(self.weights, self.bias):
            n = len(self.index)
            z = b + float(w[hits].sum()) + sum(x * o for x, o in zip(w[n:], odds))
            odds.append(max(-12.0, min(12.0, z)))
        return [1 / (1 + math.exp(-z)) for z in odds]


@dataclass(frozen=True)
class Hits:
    """Binary features of rows: row and feature of each hit, by row."""

    rows: int
    at: np.ndarray
    feature: np.ndarray

    def of(self, which: np.ndarray) -> Hits:
        new = np.full(self.rows, -1)
        new[which] = np.arange(len(which))
        kept = new[self.at] >= 0
        return Hits(len(which), new[self.at[kept]], self.feature[kept])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, w[self.feature], self.rows)

    def back(self, g: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.feature, g[self.at], n)


def fit_logistic(hits: Hits, extra: np.ndarray, y: np.ndarray, n: int, steps: int = 500, l2: float = 0.02) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression over binary features and the dense inputs `extra`.

    Each coordinate steps by its own bound on the curvature, with momentum, until none moves.
    """
    m, k = hits.rows, extra.shape[1]
    w, share = np.zeros(n + k), (y.sum() + 0.5) / (m + 1.0)
    b = prior = math.log(share / (1 - share))
    if m == 0 or y.min() == y.max():
        return w, b
    mass = np.bincount(hits.at, minlength=m) + np.abs(extra).sum(1) + 1.0
    bound = 0.25 * np.concatenate([hits.back(mass, n), np.abs(extra).T @ mass]) + l2
    v, vb = w, b
    for t in range(steps):
        z = hits.dot(v[:n]) + extra @ v[n:] + vb
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        new = v - (np.concatenate([hits.back(g, n), extra.T @ g]) + l2 * v) / bound
        nb = vb - (g.sum() + l2 * (vb - prior)) / (0.25 * mass.sum() + l2)
        v, vb = new + t / (t + 3) * (new - w), nb + t / (t + 3) * (nb - b)
        moved = max(np.abs(new - w).max(), abs(nb - b))
        w, b = new, nb
        if moved < 1e-5:
            break
    return w, b


def fit_chain(hits: Hits, labels: np.ndarray, folds: np.ndarray, index: dict[str, int], categories: tuple[str, ...]) -> Chain:
    """Links in order; the extra inputs of a link are the out-of-fold log-odds of those before it."""
    n = len(index)
    extra, weights, bias = np.zeros((hits.rows, 0)), [], []
    for c in range(len(categories)):
        y, out = labels[:, c].astype(float), np.zeros(hits.rows)
        for f in np.unique(folds):
            train, held = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
            w, b = fit_logistic(hits.of(train), extra[train], y[train], n)
            out[held] = np.clip(b + hits.of(held).dot(w[:n]) + extra[held] @ w[n:], -12, 12)
        w, b = fit_logistic(hits, extra, y, n)
        weights.append(w)
        bias.append(b)
        extra = np.column_stack([extra, out])
    return Chain(categories, index, tuple(weights), tuple(bias))


def kinds(hits: Hits, n: int, groups: int, passes: int = 50) -> np.ndarray:
    """A group for each row by principal directions: the largest group is cut where its first component is 0, until there are enough."""
    group = np.zeros(hits.rows, np.int64)
    for k in range(1, groups):
        mine = np.flatnonzero(group == np.bincount(group).argmax())
        part, v = hits.of(mine), np.linspace(1.0, 2.0, n)
        mean = part.back(np.ones(len(mine)), n) / max(1, len(mine))
        for _ in range(passes):
            s = part.dot(v) - mean @ v
            v = part.back(s, n) - s.sum() * mean
            v /= max(np.linalg.norm(v), 1e-12)
        s = part.dot(v) - mean @ v
        group[mine[s > 1e-9]] = k
    return group


def training_sample(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], max_train: int) -> DataFrame:
    """doc_id, y (a number for each category), text of at most `max_train` labelled documents, those whose id hashes lowest."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(LABEL).isNotNull()).groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(c) for c in categories))
    chosen = known.select("doc_id", F.array(*(F.col(c) for c in categories)).alias("y")).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(max_train)
    texts = docs.where("doc_id is not null").select(F.col("doc_id"), F.col("text"))
    # `chosen` has max_train rows of a few numbers at most, so it may be broadcast; one row for each id, however often it occurs
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = (), groups: int = GROUPS, max_train: int = MAX_TRAIN, min_gain: float = MIN_GAIN) -> Chain:
    """`docs` has doc_id and text; `labels` doc_id, toxic (0/1), and a column (0/1) for each of `categories`."""
    require(docs, "doc_id", "text")
    require(labels, "doc_id", LABEL, *categories)
    labelled = (*categories, LABEL)
    names = labelled if categories else (*(f"group{i + 1}" for i in range(groups)), LABEL)
    shape = T.StructType([T.StructField("fold", T.IntegerType()), T.StructField("y", T.ArrayType(T.IntegerType())), T.StructField("words", T.ArrayType(T.StringType()))])

    def make():
        def one(fold, y, text):
            yield fold, [int(bool(v)) for v in y], sorted(features(text))

        return one

    scratch = Scratch(spark, "toxicity")
    rows = training_sample(docs, labels, labelled, max_train).select(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(FOLDS)).cast("int").alias("fold"), "y", "text")
    sample = scratch.save(map_rows(rows, ["fold", "y", "text"], shape, make))
    total = sample.agg(F.count("*").alias("n"), *(F.sum(F.col("y")[i]).alias(f"p{i}") for i in range(len(labelled)))).first()
    if not total["n"]:
        return Chain(names, {}, tuple(np.zeros(i) for i in range(len(names))), tuple(math.log(0.05 / 0.95) for _ in names))
    counts = sample.select(F.explode("words").alias("word"), "y").groupBy("word").agg(F.count("*").alias("d"), *(F.sum(F.col("y")[i]).alias(f"k{i}") for i in range(len(labelled))))
    gains = [gain(F.col(f"k{i}"), F.col("d"), total[f"p{i}"] or 0, total["n"]) for i in range(len(labelled))]
    scored = counts.where("d > 1").withColumn("gain", F.greatest(*gains) if len(gains) > 1 else gains[0]).where(F.col("gain") >= min_gain)
    words = [r["word"] for r in scored.select("word").orderBy("word").collect()]
    hits, folds, y = collected(sample, words)
    if not categories:
        toxic = np.flatnonzero(y[:, -1])
        kind = np.full(len(y), -1)
        if len(toxic):
            kind[toxic] = kinds(hits.of(toxic), len(words), groups)
        y = np.column_stack([*(kind == g for g in range(groups)), y[:, -1]]).astype(np.int64)
    return fit_chain(hits, y, folds, {w: i for i, w in enumerate(words)}, names)


def collected(sample: DataFrame, words: list[str]) -> tuple[Hits, np.ndarray, np.ndarray]:
    """The bounded sample's hits, folds and labels, in an order that the data alone gives."""
    known = pa.array(words, pa.string())

    def find(batches):
        for b in batches:
            column = b.column("words")
            at = pc.index_in(column.flatten(), value_set=known)
            mine = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
            hit = at.is_valid().to_numpy(zero_copy_only=False)
            sizes = np.bincount(mine[hit], minlength=len(column))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), at.drop_null().cast(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("fold"), b.column("y"), lists], ["fold", "y", "at"])

    got = sample.mapInArrow(find, "fold int, y array<int>, at array<int>").orderBy("fold", "y", "at").toArrow().combine_chunks()
    at = got.column("at").combine_chunks()
    at = at.chunk(0) if isinstance(at, pa.ChunkedArray) else at
    sizes = pc.list_value_length(at).to_numpy(zero_copy_only=False).astype(np.int64)
    y = np.array(got.column("y").to_pylist(), np.int64)
    return Hits(len(sizes), np.repeat(np.arange(len(sizes)), sizes), at.flatten().to_numpy(zero_copy_only=False).astype(np.int64)), got.column("fold").to_numpy(), y


def gain(k: Column, d: Column, positive: int, n: int) -> Column:
    """Evidence for a category: log-likelihood ratio of a word's k positive among d documents against the share of all; 0 if its share is no larger."""
    share = positive / n if n else 0.0
    if not 0 < share < 1:
        return F.lit(0.0)
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    return F.when(k > d * share, part(k, d * share) + part(d - k, d * (1 - share))).otherwise(0.0)


def score(docs: DataFrame, chain: Chain, columns: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """`columns` of `docs` with a probability for each category and `is_toxic` (the last one at `threshold` or above)."""
    require(docs, "text", *columns)
    names = [f"p_{c}" for c in chain.categories]
    columns = [c for c in columns if c not in (*names, "is_toxic")]
    schema = T.StructType([*(docs.schema[c] for c in columns), *(T.StructField(x, T.DoubleType()) for x in names), T.StructField("is_toxic", T.BooleanType())])

    def make():
        def one(text, *rest):
            p = chain.probabilities(text)
            yield (*rest, *p, p[-1] >= threshold)

        return one

    # by position, so no name can clash
    given = docs.select(F.col("text").alias("c0"), *(F.col(f"`{c}`").alias(f"c{i + 1}") for i, c in enumerate(columns)))
    return map_rows(given, given.columns, schema, make)


def drop_toxic(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that aren't toxic, with all their columns."""
    require(docs, "text")
    return keep_rows(docs, "text", lambda: lambda text: chain.probabilities(text)[-1] < threshold)

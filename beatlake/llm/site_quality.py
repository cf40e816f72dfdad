"""Quality by hierarchical empirical Bayes over sites.

A logistic model of text statistics, trained on at most `MAX_TRAIN` labelled
documents (one row for each id), gives each document's evidence. Sites are
hosts and paths within them. A host's share of good documents has a Beta prior
around the share of all documents, a path's one around its host's posterior;
the priors' strengths come from the spread of hosts and of paths (moments), so
a site with few documents is shrunk towards what stands above it. Scores of a
site are sums over its documents, labelled ones with their label, merged
map-side.

A document's posterior adds the log-odds of its path, relative to all
documents', to those of its own text, times `SITE_WEIGHT`. Its own score is
taken out of all three sums first, so nothing counts twice.

Defined results: null text counts as empty; a null host or path is a site of
its own. Without labels of both classes the evidence is neutral and all
documents stay. Repeated rows count and return once each; repeated labels
count once, as the largest; of texts with the same labelled doc_id the
smallest is learned from. Ids may be of any type. An empty table gives no row.
Extra columns of any name are read only through `host` and `path`.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatlake.llm.common import map_rows, require
from beatlake.scratch import Scratch

MAX_TRAIN = 20_000
SITE_WEIGHT, THRESHOLD = 0.5, 0.5
LETTERS = re.compile(r"[^\W\d_]+")
MARKS = re.compile(r"[#*$%&|<>{}\[\]=_~^\\]")
#: Moments bound the strength of a prior to this range, in documents.
WEAKEST, STRONGEST = 1.0, 1000.0


def measures(text: str | None) -> list[float]:
    """Bounded statistics of a whole text, all near 0 to 1."""
    text = text or ""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    letters = sum(map(len, LETTERS.findall(text)))
    lower = [w.lower().strip(".,;:!?") for w in words]
    lines = [line for line in text.split("\n") if line.strip()]
    return [
        min(1.0, np.log1p(len(words)) / 10),
        float(len(words) < 5),
        float(len(words) < 20),
        min(1.0, letters / size),
        min(1.0, len(MARKS.findall(text)) / n),
        min(1.0, text.count("!") / n),
        min(1.0, sum(map(str.isdigit, text)) / size * 5),
        min(1.0, sum(map(str.isupper, text)) / max(1, letters)),
        min(1.0, letters / n / 12),
        len(set(lower)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(a == b for a, b in zip(lower, lower[1:])) / n,
        min(1.0, (text.count(".") + text.count(",")) / n),
    ]


def fit_evidence(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps, the bias last; none for labels of one class."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        return w
    ridge = np.diag([l2] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, max_train: int) -> np.ndarray:
    chosen = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
        .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(max_train)
    )
    shape = T.StructType([T.StructField("y", T.DoubleType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def make():
        def one(label, text):
            yield float(label), measures(text)

        return one

    # `chosen` has max_train rows of two values at most, so it may be broadcast; one row for each id, however often it occurs
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = map_rows(texts, ["label", "text"], shape, make).orderBy("x", "y").collect()
    n = len(measures(""))
    return fit_evidence(np.array([r["x"] for r in rows]).reshape(-1, n), np.array([r["y"] for r in rows]))


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def strength(sites: DataFrame, share: Column, prior: Column) -> float:
    """Documents that a prior counts as, by moments: the spread of shares around the prior beyond that of their own size."""
    r = sites.where("n > 1").agg(F.sum((share - prior) ** 2 * F.col("n")).alias("s"), F.sum(prior * (1 - prior)).alias("e"), F.sum(prior * (1 - prior) * F.col("n")).alias("v"), F.count("*").alias("k")).first()
    if not r["k"] or r["s"] is None or r["s"] <= r["e"]:
        return STRONGEST
    between = (r["s"] - r["e"]) / max(r["v"] - r["e"], 1e-9)
    return float(min(STRONGEST, max(WEAKEST, 1 / max(between, 1e-9) - 1)))


def sums(scored: DataFrame, scratch: Scratch) -> tuple[DataFrame, float, int, float, float]:
    """Counts and scores of each path and its host; those of all documents; strengths of the priors of hosts and of paths. `scored` has host, path and good (0 to 1)."""
    paths = scratch.save(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("g")))
    hosts = scratch.save(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("g").alias("g")))
    total = hosts.agg(F.sum("g").alias("g"), F.sum("n").alias("n")).first()
    g, n = total["g"] or 0.0, total["n"] or 0
    share = g / n if n else 0.5
    by_host = strength(hosts, F.col("g") / F.col("n"), F.lit(share))
    above = hosts.select(F.col("host").alias("of"), F.col("n").alias("n_host"), F.col("g").alias("g_host"))
    below = scratch.save(paths.join(above, F.col("host").eqNullSafe(F.col("of"))).drop("of"))
    around = (F.col("g_host") + by_host * share) / (F.col("n_host") + by_host)
    # a host's only path says nothing about the spread of paths
    by_path = strength(below.where("n < n_host"), F.col("g") / F.col("n"), around)
    return below, g, n, by_host, by_path


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, host: Column, path: Column, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, host, path, p_text, host_share, path_share (both without the document itself), p_quality and kept of every row of `docs`."""
    require(docs, "doc_id", "text")
    require(labels, "doc_id", "quality")
    scratch = Scratch(spark, "quality")
    w = train(docs, labels, max_train)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("p_text", T.DoubleType())])

    def make():
        def one(doc_id, h, p, text):
            z = float(np.dot(w[:-1], measures(text)) + w[-1])
            yield doc_id, h, p, 1 / (1 + float(np.exp(-max(-30.0, min(30.0, z)))))

        return one

    rows = docs.select("doc_id", host.cast("string").alias("host"), path.cast("string").alias("path"), "text")
    evidence = scratch.save(map_rows(rows, ["doc_id", "host", "path", "text"], schema, make))
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    scored = scratch.save(evidence.join(known, "doc_id", "left").select("doc_id", "host", "path", "p_text", F.coalesce("label", "p_text").alias("good")))
    sites, g, n, by_host, by_path = sums(scored, scratch)
    others = F.lit((g if n > 1 else 0.5)) - (F.col("good") if n > 1 else F.lit(0.0))
    rest = others / float(max(n - 1, 1))
    both = scored.alias("a").join(sites.alias("b"), F.col("a.host").eqNullSafe(F.col("b.host")) & F.col("a.path").eqNullSafe(F.col("b.path"))).select("a.*", "b.n", "b.g", "b.n_host", "b.g_host")
    # sums of many doubles less one of them can fall below 0 by rounding
    less = lambda c: F.greatest(F.col(c) - F.col("good"), F.lit(0.0))
    both = both.withColumn("rest", F.greatest(rest, F.lit(0.0)))
    both = both.withColumn("host_share", (less("g_host") + by_host * F.col("rest")) / (F.col("n_host") - 1 + by_host))
    both = both.withColumn("path_share", (less("g") + by_path * F.col("host_share")) / (F.col("n") - 1 + by_path))
    odds = logit(F.col("p_text")) + SITE_WEIGHT * (logit(F.col("path_share")) - logit(F.col("rest")))
    out = both.select("doc_id", "host", "path", "p_text", "host_share", "path_share", (1 / (1 + F.exp(-odds))).alias("p_quality"))
    return out.withColumn("kept", F.col("p_quality") >= (THRESHOLD if w.any() else 0.0))


def visible_text(html: Column) -> Column:
    """A page's text: scripts, styles and tags become spaces."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")


def site_of(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of a URL; null where it has none or is broken."""
    return F.try_parse_url(url, F.lit("HOST")), F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), r"^/([^/]+)/", 1)

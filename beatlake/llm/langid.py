"""Language identification in two steps: family first, then its languages.

A linear support vector machine for each family against the rest picks the
family; within it, one machine for each pair of languages votes. Features
are square roots of the shares of hashed byte trigrams of the lower-cased
text, so they don't depend on its length.

Every language that occurs is learned. Training reads about `PER_LANG`
documents of each (those whose id hashes below the language's share), chosen
by crc32(doc_id) mod 4 and a non-null lang. Each machine is trained in a Spark
task of its own, on sparse rows: a pair's on its two languages' documents, a
family's on about `FAMILY_ROWS` documents of all languages, evenly. Prediction
is one pass over whole texts and reads nothing else. A table of more than
`MAX_LANGS` lang values is an error, since those can't be languages.

Defined results: `und` with score 0 where text is null or holds no letter, or
where there was nothing to learn from. A family of one language needs no
vote. Ties go to the larger summed margin, then to the smaller name. Repeated
rows predict alike. An empty table gives no row. Extra columns of any name are
not read.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatlake.llm.common import map_rows, require
from beatlake.scratch import Scratch

# Families of languages by ISO 639-1 code. Any other language is its own family.
FAMILIES = {
    "germanic": ("da", "de", "en", "fy", "is", "lb", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
FAMILY = {lang: f for f, langs in FAMILIES.items() for lang in langs}

BITS = 12
PER_LANG, FAMILY_ROWS, MAX_LANGS = 800, 12_000, 10_000
FOLDS, HELD_OUT = 4, 2
UNDEFINED = "und"
#: Bytes whose trigrams are counted at once.
BLOCK = 1 << 20


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's byte trigrams, and the square roots of their shares."""
    raw = np.frombuffer(b" " + " ".join(text.lower().split()).encode() + b" ", np.uint8)
    counts = np.zeros(1 << BITS, np.int64)
    for at in range(0, len(raw) - 2, BLOCK):
        b = raw[at : at + BLOCK + 2].astype(np.uint32)
        code = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
        counts += np.bincount((code ^ code >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS), minlength=1 << BITS)
    hit = np.flatnonzero(counts)
    return hit, np.sqrt(counts[hit] / max(1, counts.sum()))


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def train_machine(at: list[np.ndarray], x: list[np.ndarray], y: np.ndarray, c: float = 10.0, passes: int = 15) -> tuple[np.ndarray, float]:
    """A linear support vector machine (classes weighted evenly) by dual coordinate descent over sparse rows; the bias is a constant input."""
    at = [np.append(a, 1 << BITS) for a in at]
    x = [np.append(v, 0.3) for v in x]
    bound = c * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    norm, alpha, w = [float(v @ v) for v in x], np.zeros(len(y)), np.zeros((1 << BITS) + 1)
    order = np.random.default_rng(0)
    for _ in range(passes):
        for i in order.permutation(len(y)):
            new = min(max(alpha[i] - (y[i] * (w[at[i]] @ x[i]) - 1) / norm[i], 0.0), bound[i])
            if new != alpha[i]:
                w[at[i]] += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w[:-1], float(w[-1] * 0.3)


@dataclass(frozen=True)
class Model:
    #: Languages of each family.
    families: dict[str, tuple[str, ...]]
    #: (name, other) to weights and bias; families against the rest have other "".
    machines: dict[tuple[str, str], tuple[np.ndarray, float]]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not has_letter(text):
            return UNDEFINED, 0.0
        hit, x = trigrams(text)
        margin = lambda key: float(self.machines[key][0][hit] @ x) + self.machines[key][1]
        sure = lambda m: 1 / (1 + math.exp(-max(-30.0, min(30.0, 2 * m))))
        names = sorted(self.families)
        if len(names) == 1:
            family, score = names[0], 1.0
        else:
            m = [margin((f, "")) for f in names]
            best = int(np.argmax(m))
            family, score = names[best], sure(m[best])
        langs = self.families[family]
        if len(langs) == 1:
            return langs[0], score
        votes, total, least = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0), dict.fromkeys(langs, 1.0)
        for a, b in itertools.combinations(langs, 2):
            m = margin((a, b))
            for lang, mine in ((a, m), (b, -m)):
                votes[lang] += mine > 0
                total[lang] += mine
                least[lang] = min(least[lang], sure(mine))
        best = max(langs, key=lambda x: (votes[x], total[x]))
        return best, score * least[best]


def fit(spark: SparkSession, docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Learns from text and lang of the documents that aren't held out."""
    require(docs, "doc_id", "text", "lang")
    seen = docs.where(F.coalesce(fold(F.col("doc_id")) != HELD_OUT, F.lit(True)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = seen.groupBy("lang").count().limit(MAX_LANGS + 1).collect()
    if len(found) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} lang values")
    counts = {r["lang"]: r["count"] for r in found}
    if not counts:
        return Model({}, {})
    families: dict[str, tuple[str, ...]] = {}
    for lang in sorted(counts):
        f = FAMILY.get(lang, f"only {lang}")
        families[f] = (*families.get(f, ()), lang)
    shares = spark.createDataFrame([(lang, min(1.0, per_lang / n)) for lang, n in counts.items()], "lang string, share double")
    shape = T.StructType([T.StructField("lang", T.StringType()), T.StructField("rank", T.DoubleType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.FloatType()))])

    def make():
        def one(lang, rank, text):
            if has_letter(text):
                at, x = trigrams(text)
                yield lang, rank, at.tolist(), x.tolist()

        return one

    scratch = Scratch(spark, "langid")
    u = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    # `shares` has a row a language, MAX_LANGS at most, so it may be broadcast; rank says how far down its language's sample a document is
    drawn = seen.select("lang", "text", u.alias("u")).join(F.broadcast(shares), "lang").where("u < share").select("lang", (F.col("u") / F.col("share")).alias("rank"), "text")
    sample = scratch.save(map_rows(drawn, ["lang", "rank", "text"], shape, make))
    learned = {r["lang"] for r in sample.select("lang").distinct().collect()}
    families = {f: tuple(x for x in langs if x in learned) for f, langs in families.items()}
    families = {f: langs for f, langs in families.items() if langs}
    if not families:
        return Model({}, {})
    family_of = {lang: f for f, langs in families.items() for lang in langs}
    # the tasks that a language's documents go to, and the part of them: each family's machine, and its own pairs
    some = min(1.0, FAMILY_ROWS / (per_lang * len(family_of)))
    goes: dict[str, list[tuple[str, str, int, float]]] = {lang: [] for lang in family_of}
    if len(families) > 1:
        for lang, f in family_of.items():
            goes[lang] += [(g, "", 1 if g == f else -1, 1.0 if g == f else some) for g in families]
    for langs in families.values():
        for a, b in itertools.combinations(langs, 2):
            goes[a].append((a, b, 1, 1.0))
            goes[b].append((a, b, -1, 1.0))
    if not any(goes.values()):
        return Model(families, {})
    plan = spark.createDataFrame([(lang, *g) for lang, gs in goes.items() for g in gs], "lang string, name string, other string, y int, part double")

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        w, b = train_machine(list(pdf["at"]), list(pdf["x"]), pdf["y"].to_numpy(float))
        return pd.DataFrame({"name": pdf["name"][:1], "other": pdf["other"][:1], "w": [w], "b": [b]})

    # the plan is written, so that Spark sees its size
    rows = sample.join(scratch.save(plan), "lang").where("rank < part").select("name", "other", "y", "at", "x")
    made = rows.groupBy("name", "other").applyInPandas(train, "name string, other string, w array<double>, b double")
    return Model(families, {(r["name"], r["other"]): (np.array(r["w"]), r["b"]) for r in made.collect()})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    require(docs, "doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def make():
        def one(doc_id, held, text):
            yield (doc_id, held, *model.predict(text))

        return one

    rows = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held"), "text")
    return map_rows(rows, ["doc_id", "held", "text"], schema, make)

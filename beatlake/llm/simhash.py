"""Near-duplicates by SimHash and covering locality-sensitive hashing.

A fingerprint takes the majority of the bits of the hashes of all word
shingles of a text. Fingerprints within `RADIUS` differing bits are linked.

Candidates come from a covering family of bit masks: position i gets a
non-zero vector m(i) of RADIUS+1 bits, and for each of the 2^(RADIUS+1)-1
non-zero vectors v there is a mask of the positions with <m(i), v> odd. Any
RADIUS vectors leave some v orthogonal to all of them, so whatever RADIUS
positions differ, some mask has none of them: every pair within the radius
has equal bits under that mask, and no link is lost.

Equal fingerprints are one node, so copies never meet as pairs. A bucket of
more than `BUCKET` nodes is not compared: its nodes get keys of a second
covering family over the bits that the first mask left out, and so on, until
buckets are small or no more than 2^10 values are possible. Links within a
bucket are reduced to a spanning forest before they leave the task, and
components are found by alternating large-star and small-star steps over
tables in the shared folder.

Defined results: null text counts as empty; a text without a word has
fingerprint zero and is linked like any other. Repeated rows each return
their row. Rows whose doc_id is null have a fingerprint too, but can't name a
component: theirs is the smallest id there, or null if none has one. An empty
table gives none. Extra columns of any name are returned by `keep_first` as
they are.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatlake.llm.common import boxed, map_rows, require, unboxed
from beatlake.scratch import Scratch

RADIUS, SHINGLE, SEED, BUCKET = 3, 3, 42, 1024
#: Hashes whose bits are counted at once.
BLOCK = 1 << 15


def simhash(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of UTF-8 text; words are runs without ASCII white space, A-Z are lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = map(xxhash.xxh64_intdigest, grams, itertools.repeat(SEED))
    while len(block := np.fromiter(itertools.islice(hashes, BLOCK), np.uint64)):
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, `text_key` (a hash of the text) and `fp` (the 64 bits as a signed long) of every row."""
    require(docs, "doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text_key", T.LongType()), T.StructField("fp", T.LongType())])

    def make():
        def one(doc_id, key, text):
            fp = simhash(text)
            yield doc_id, key, fp - (1 << 64) if fp >> 63 else fp

        return one

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.col("text").cast("binary").alias("raw"))
    return map_rows(rows, ["doc_id", "text_key", "raw"], schema, make)


def masks(positions: list[int], radius: int, seed: int) -> list[int]:
    """Covering masks over the given bit positions, as signed longs; none where too few positions are left to tell apart."""
    vectors = np.random.default_rng(seed).permutation(np.arange(len(positions)) % ((1 << (radius + 1)) - 1) + 1)
    out = []
    for v in range(1, 1 << (radius + 1)):
        mask = sum(1 << p for p, m in zip(positions, vectors) if bin(int(m) & v).count("1") % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def positions(mask: int) -> list[int]:
    return [i for i in range(64) if (mask >> i) & 1]


def refined(mask: Column, radius: int, level: int, seen: list[int]) -> Column:
    """Masks of the next level, each with the bits of the mask before: an array for each mask in `seen`."""
    whole = (1 << 64) - 1
    table = F.create_map(*(x for m in seen for x in (F.lit(m), F.array(*(F.lit(m | fine) for fine in masks(positions(~m & whole), radius, level))))))
    return F.element_at(table, mask)


def links(batches, radius: int = RADIUS):
    """A spanning forest of the links in each bucket; a bucket is a sorted list of distinct fingerprints."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        column = batch.column(0)
        ends, flat = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
        pairs = ends[:-1][np.diff(ends) == 2]
        pairs = pairs[np.bitwise_count(flat[pairs] ^ flat[pairs + 1]) <= radius]
        a: list[int] = flat[pairs].view(np.int64).tolist()
        b: list[int] = flat[pairs + 1].view(np.int64).tolist()
        for k in np.flatnonzero(np.diff(ends) > 2):
            values = flat[ends[k] : ends[k + 1]]
            left, todo = np.ones(len(values), bool), []
            while todo or left.any():
                if not todo:
                    todo = [int(np.argmax(left))]
                    left[todo[0]] = False
                at = todo.pop()
                rest = np.flatnonzero(left)
                near = rest[np.bitwise_count(values[rest] ^ values[at]) <= radius]
                left[near] = False
                todo += near.tolist()
                a += [int(values[at].view(np.int64))] * len(near)
                b += values[near].view(np.int64).tolist()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)


def candidate_links(nodes: DataFrame, scratch: Scratch, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between the distinct fingerprints in `nodes.fp` that connect all that are within the radius."""
    seen = masks(list(range(64)), radius, 0)
    keys = nodes.select("fp", F.explode(F.array(*(F.lit(m) for m in seen))).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    found = []
    for level in itertools.count(1):
        sizes = scratch.save(keys.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"))
        bounded = max(64 - bin(m & ((1 << 64) - 1)).count("1") for m in seen) <= 10
        hot = [] if bounded else [r["mask"] for r in sizes.where(F.col("n") > bucket).select("mask").distinct().collect()]  # masks only
        # written before it is grouped, so that Spark can split a large bucket's rows among tasks
        marked = scratch.save(keys.join(sizes.withColumn("hot", (F.col("n") > bucket) & F.lit(not bounded)), ["mask", "key"]))
        small = marked.where("not hot").groupBy("mask", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
        found.append(scratch.save(small.select("fps").mapInArrow(lambda x: links(x, radius), "a bigint, b bigint")))
        if not hot:
            break
        fine = marked.where("hot").select("fp", F.explode(refined(F.col("mask"), radius, level, hot)).alias("mask"))
        keys = scratch.save(fine.distinct().withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))))
        seen = [r["mask"] for r in keys.select("mask").distinct().collect()]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (the smallest node of its component) for each node of the links (a, b).

    Large-star links each larger neighbour of a node to the smallest one;
    small-star does so for the smaller ones. Both only need each node's
    minimum, so a node with very many neighbours is a sum of partial minima
    and a join that Spark may split.
    """
    now = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = scratch.save(small)
        scratch.drop(now)
        scratch.drop(large)
        now = after
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if new == state:
            return now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        state = new


def families(marks: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """fp and the fingerprint that stands for its component, for each distinct fingerprint of `marks`."""
    nodes = scratch.save(marks.select("fp").distinct())
    roots = components(candidate_links(nodes, scratch, radius), scratch)
    return scratch.save(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(spark: SparkSession, docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id of every row of `docs`."""
    scratch = Scratch(spark, "simhash")
    marks = scratch.save(fingerprints(docs))
    rooted = families(marks, scratch, radius)
    # minima by fingerprint first, so a fingerprint that is everywhere is one row when it is joined
    least = marks.groupBy("fp").agg(F.min("doc_id").alias("least")).join(rooted, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marks.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """`docs` with one row of each component: the smallest doc_id, null last; of different texts with that id, the one whose text hashes lowest.

    Rows are told apart by id and text, so of repeated rows one stays.
    """
    require(docs, "doc_id", "text")
    scratch = Scratch(spark, "simhash")
    marks = scratch.save(fingerprints(docs))
    # minima by fingerprint first, so a fingerprint that is everywhere is one row when it is joined
    each = marks.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("f"))
    first = each.join(families(marks, scratch), "fp").groupBy("root").agg(F.min("f").alias("f"))
    ids = lambda c: (F.col(c).isNull().alias("no_id"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("id"))
    chosen = first.select(F.col("f.doc_id").alias("d"), F.col("f.text_key").alias("text_key")).select(*ids("d"), "text_key")
    # keys without nulls, so that the join and the choice among repeated rows share one exchange
    rows = boxed(docs, *ids("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    keys = ["no_id", "id", "text_key"]
    return rows.join(chosen, keys, "left_semi").dropDuplicates(keys).select(*unboxed(docs.columns))

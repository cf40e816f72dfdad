"""Repeated strings of any texts by distributed prefix doubling over sampled positions.

Text is UTF-8 bytes. A string of `threshold` bytes that starts at two places
or more, in one text or several, is repeated, and every byte that one covers
is too.

A position's rank at length l stands for its next l bytes; the rank at a
length up to 2l is the pair of the ranks at l of the position and of one
further on. Spark sorts the pairs, and a position whose pair is no other's is
unique and goes. The lengths grow until they reach the threshold; the first
ranks are 64-bit polynomial names of half the first length.

Not all positions are ranked at the shorter lengths. A string of `threshold`
bytes is told by the position within it whose l bytes have the least hash
(the first of equals), as any equal string picks the same one; so a position
stands for a run of starts, and one in about (threshold - l) / 2 bytes is
ranked. Each carries a name of all bytes that its starts cover: where both
are equal for several positions, all of their starts are repeated, they are
settled, and one of them goes on for all. Starts of unique ranks are settled
as unique. Where equal ranks have different surroundings, a representative of
each goes on to the next length, with denser positions. At the threshold
every start left is its own position, and the sort decides. Rows of a round
thus follow the ends of repeats, not their number or their copies.

Equal texts are one text: of two copies at least as long as the threshold
every byte is repeated, and one copy stands for all in the search.

Texts lie in a table bucketed by their key, so a round exchanges spans and
ranks only. Names are of 64 bits, ranks of 128, texts' keys 128 bits of
SHA-256; two strings that differ by chance alone share a rank with a
probability of 2^-64 for each of their pieces that differ. Long texts are
read in pieces, so memory follows a piece and the text itself.

Defined results: null text counts as empty; texts under the threshold have no
repeats. Repeated rows are copies like any other. Extra columns of any name
are returned by `remove`. Empty tables give none.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatlake.llm.common import boxed, map_rows, require, slices, unboxed
from beatlake.scratch import Scratch

THRESHOLD = 400
#: Starts whose names are computed at once.
PIECE = 1 << 15
#: Any odd number of 64 bits; texts are told apart by powers of it.
BASE = 0x9E3779B97F4A7C15
#: Rows of a batch of positions.
BATCH = 1 << 16
RANK, SURROUNDINGS = ["rank", "further"], ["before", "run", "around"]
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def lengths(threshold: int) -> list[int]:
    """Growing lengths, each at most twice the one before; the last is the threshold."""
    steps = [threshold, threshold - threshold // 64, threshold - threshold // 8]
    part = threshold
    for _ in range(3):
        part = (part + 1) // 2
        steps.append(part)
    return sorted(set(steps))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2^64."""
    up = np.full(n, BASE, np.uint64)
    down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def least(hashes: np.ndarray, width: int) -> np.ndarray:
    """Index of the least hash of each window of that width, the first of equals."""
    at, span = np.arange(len(hashes)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[:-step], at[step:]
        at = np.where(hashes[right] < hashes[left], right, left)
        span += step
    return at


def positions(data: np.ndarray, spans: list[tuple[int, int]], length: int, before: int, threshold: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Ranked positions of the starts in `spans` (first, last) of a text: rank, further, before, run, around, first start."""
    up, down = powers(PIECE + 2 * threshold)
    for lo, hi in spans:
        for first in range(lo, hi + 1, PIECE):
            n = min(hi + 1 - first, PIECE)  # starts
            raw = data[first : first + n - 1 + threshold].astype(np.uint64) + np.uint64(1)
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(raw * up[: len(raw)], out=sums[1:])
            name = lambda at, size: mixed((sums[at + size] - sums[at]) * down[at])
            if length == threshold:
                at = start = np.arange(n)
                run = np.ones(n, np.int64)
            else:
                width = threshold + 1 - length
                chosen = least(name(np.arange(n - 1 + width), length), width)
                start = np.concatenate([[0], np.flatnonzero(np.diff(chosen)) + 1])
                at, run = chosen[start], np.diff(np.append(start, n))
            around = mixed((sums[start + run - 1 + threshold] - sums[start]) * down[start])
            yield name(at, before), name(at + length - before, before), at - start, run, around, start + first


def merged(spans: list) -> list[tuple[int, int]]:
    """Spans (first, last) in order, joined where they touch or overlap."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def ranked(texts: DataFrame, length: int, before: int, threshold: int) -> DataFrame:
    """Positions of the starts in the column `spans` of each text, or of all starts where there is no such column."""
    given = "spans" in texts.columns
    schema = T.StructType([texts.schema["text_key"], *(T.StructField(c, T.LongType()) for c in (*RANK, *SURROUNDINGS, "lo"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, tuple[np.ndarray, ...]]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys = pa.array([k for k, _ in held], pa.binary()).take(pa.array(np.repeat(np.arange(len(held)), [len(c[0]) for _, c in held])))
            columns = [pa.array(np.concatenate(c).astype(np.uint64, copy=False).view(np.int64)) for c in zip(*(c for _, c in held))]
            held.clear()
            return pa.RecordBatch.from_arrays([keys, *columns], names=schema.names)

        for batch in batches:
            for part in slices(batch):
                keys = part.column(0).to_pylist()
                spans = part.column(2).to_pylist() if given else [None] * len(keys)
                for key, raw, mine in zip(keys, part.column(1), spans):
                    data = np.frombuffer(raw.as_buffer(), np.uint8)
                    if len(data) < threshold:
                        continue
                    for found in positions(data, merged(mine) if given else [(0, len(data) - threshold)], length, before, threshold):
                        held.append((key, found))
                        size += len(found[0])
                        if size >= BATCH:
                            yield flush()
                            size = 0
        if held:
            yield flush()

    return texts.select("text_key", "text", *(["spans"] if given else [])).mapInArrow(run, schema)


def last(lo: str = "lo", run: str = "run"):
    return (F.col(lo) + F.col(run) - 1).alias("hi")


def text_key(text) -> F.Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


class Repeats:
    """The repeated spans of a corpus: `texts` has one row a different text (text_key, text, copies), `spans` the repeated ones of those that have any."""

    def __init__(self, spark: SparkSession, docs: DataFrame, threshold: int = THRESHOLD):
        require(docs, "text")
        self.threshold, scratch = threshold, Scratch(spark, "repeats")
        key = text_key(F.col("text")).alias("text_key")
        once = docs.select(key, F.coalesce("text", F.lit("")).cast("binary").alias("text")).groupBy("text_key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
        self.texts = scratch.bucketed(once, int(spark.conf.get("spark.sql.shuffle.partitions")), "text_key", dealt=True)
        steps = lengths(threshold)
        found, todo = [], self.texts
        for before, length in zip([steps[0], *steps], steps):
            if length == steps[0] and length < threshold:
                continue  # named at once, not sorted
            rows = scratch.save(ranked(todo, length, before, threshold))
            classes = scratch.save(rows.groupBy(*RANK, *SURROUNDINGS).agg(F.count("*").alias("times"), F.min(F.struct("text_key", "lo")).alias("one")))
            settled = rows.join(classes.where("times > 1").select(*RANK, *SURROUNDINGS), [*RANK, *SURROUNDINGS], "left_semi")
            found.append(scratch.save(settled.select("text_key", "lo", last())))
            if length == threshold:
                break
            # written, so that the join reads two exchanges and a frequent rank can be split
            mixed_ranks = scratch.save(classes.groupBy(*RANK).agg(F.count("*").alias("kinds")).where("kinds > 1").select(*RANK))
            left = classes.join(mixed_ranks, RANK, "left_semi").select("one.text_key", "one.lo", last("one.lo"))
            spans = scratch.save(left.groupBy("text_key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
            for table in (rows, classes, mixed_ranks):
                scratch.drop(table)
            todo = self.texts.join(spans, "text_key")
        every = functools.reduce(DataFrame.unionByName, found)
        self.spans = every.groupBy("text_key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def removed(self) -> DataFrame:
        """Each different text with the spans that go: text_key, text, copies, spans (start, end) of bytes."""
        threshold = self.threshold

        def make():
            def one(key, text, copies, spans):
                if copies > 1 and len(text) >= threshold:
                    spans = [(0, len(text))]
                else:
                    spans = [(s["start"], s["end"]) for s in covered(spans or [], threshold)]
                yield key, text, copies, spans

            return one

        schema = T.StructType([*(self.texts.schema[c] for c in ("text_key", "text", "copies")), T.StructField("spans", SPANS)])
        return map_rows(self.texts.join(self.spans, "text_key", "left"), ["text_key", "text", "copies", "spans"], schema, make)


def covered(starts: list, threshold: int) -> list[dict[str, int]]:
    """Maximal runs of bytes that strings at the given spans of starts cover."""
    out: list[dict[str, int]] = []
    for lo, hi in merged(starts):
        if out and lo <= out[-1]["end"]:
            out[-1]["end"] = hi + threshold
        else:
            out.append({"start": lo, "end": hi + threshold})
    return out


def kept(text: bytes, spans: list) -> Iterator[bytes]:
    at = 0
    for s in spans:
        yield text[at : s["start"]]
        at = s["end"]
    yield text[at:]


def digests(texts: DataFrame) -> DataFrame:
    """text_key, n_bytes, n_removed, n_spans and kept_sha256 of each text of `Repeats.removed`."""
    schema = T.StructType([texts.schema["text_key"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])

    def make():
        def one(key, text, spans):
            sha = hashlib.sha256()
            for piece in kept(text, spans):
                sha.update(piece)
            yield key, len(text), sum(s["end"] - s["start"] for s in spans), len(spans), sha.hexdigest()

        return one

    return map_rows(texts, ["text_key", "text", "spans"], schema, make)


def of_documents(docs: DataFrame, by_text: DataFrame, own: tuple[str, ...]) -> DataFrame:
    """`docs` with columns `own` of their text's row in `by_text`."""
    rows = boxed(docs, text_key(F.col("text")).alias("text_key"))
    return rows.join(by_text.select("text_key", *own), "text_key").select(*unboxed(docs.columns, own), *own)


def remove(spark: SparkSession, docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """`docs` with `spans`, the repeated bytes of each text, and `kept`, the bytes that are left."""
    texts = Repeats(spark, docs, threshold).removed()

    def make():
        def one(key, text, spans):
            yield key, [(s["start"], s["end"]) for s in spans], b"".join(kept(text, spans))

        return one

    schema = T.StructType([texts.schema["text_key"], T.StructField("spans", SPANS), T.StructField("kept", T.BinaryType())])
    return of_documents(docs, map_rows(texts, ["text_key", "text", "spans"], schema, make), ("spans", "kept"))

"""Ranked lexical search: WAND in shards of documents, whose heaps are merged.

Scores are BM25 in integers (`weight`, `impacts`). One pass over all texts
counts terms; it keeps only those that hash like a term of some item, and
corpus counts (documents, length, document frequencies) come from all rows.
Documents are dealt by a hash to shards of bounded size and items to blocks,
and each pair of a shard and a block is one group: an inverted index of the
shard's postings, on which the block's items are searched one by one.

WAND goes over the documents in ascending doc_id, a window at a time. A
term's greatest impact in the shard bounds what it adds to any document.
Terms in ascending order of that bound, as long as their sum doesn't beat
the heap's threshold, can't make a pivot: a document that holds only such
terms is passed without being looked at. The documents of the other terms'
lists are pivots where the bounds of the terms they hold, with all that the
passed terms could add, beat the threshold; only these are scored, and the
passed terms' cursors jump to them, from the largest bound down, while they
can still beat it. Ties go to the smaller doc_id, so a later document must
beat the threshold, not reach it.

Defined results: a null text has no term; items without a term and items no
document shares a term with return nothing. Repeated rows of documents are
each ranked, and repeated items each answered. Null doc_ids come after all
others of their score. Terms of any length are whole. Empty tables give no
rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatlake.llm.common import require, slices
from beatlake.scratch import Scratch

#: Best documents of an item.
TOP = 10
#: Bits of the map of terms that items use; a term that shares a bit by chance is dropped by the exact join later.
BITS = 1 << 17
#: Postings of a shard, documents of a shard at least, items of a block, documents of a window.
SHARD, FEW, ITEMS, WINDOW = 1_500_000, 1024, 1024, 4096
#: Bytes of a text whose terms are Python objects at once.
CHUNK = 1 << 20
#: Everything but digits, letters and what is beyond ASCII parts terms; A-Z become a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def count_terms(text: bytes | None) -> tuple[int, Counter]:
    """Number of terms with repeats, and how often each occurs."""
    flat, counts, n, at = (text or b"").translate(FOLD), Counter(), 0, 0
    while at < len(flat):
        end = flat.find(b" ", at + CHUNK) if at + CHUNK < len(flat) else -1
        end = len(flat) if end < 0 else end
        found = flat[at:end].split()
        counts.update(found)
        n += len(found)
        at = end
    return n, counts


def counted(rows: DataFrame, keys: list[str], used: bytes | None = None) -> DataFrame:
    """`keys`, `n`, and each row's different terms with their counts; of terms, only those whose bit is set in `used`."""
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.BinaryType())), T.StructField("tfs", T.ArrayType(T.LongType()))])
    target = pa.schema([pa.field("n", pa.int64()), pa.field("terms", pa.list_(pa.binary())), pa.field("tfs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, terms, tfs = [], [], []
                for text in part.column(len(keys)).to_pylist():
                    size, counts = count_terms(text)
                    kept = list(counts) if used is None else [t for t in counts if used[zlib.crc32(t) % BITS]]
                    n.append(size)
                    terms.append(kept)
                    tfs.append([counts[t] for t in kept])
                own = [pa.array(c, t) for c, t in zip((n, terms, tfs), target.types)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *own], names=[*keys, *target.names])

    return rows.select(*keys, F.col("text").cast("binary")).mapInArrow(run, schema)


def weight(n_docs: int, df) -> F.Column:
    return F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n_docs + 2)) / (2.0 * df + 1.0))).cast("bigint")


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """What a term's weight is multiplied with in documents of n terms that hold it tf times."""
    m = 100 - 75 + (75 * n * n_docs) // length
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Shard:
    """An inverted index of some documents; document numbers follow doc_id, nulls last."""

    def __init__(self, docs: pa.Table, n_docs: int, length: int):
        ids = docs.column("doc_id").combine_chunks()
        order = pc.array_sort_indices(ids, null_placement="at_end")
        docs = docs.take(order).combine_chunks()
        self.ids = docs.column("doc_id").combine_chunks()
        lists = docs.column("terms").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        coded = lists.flatten().dictionary_encode()
        tf = docs.column("tfs").combine_chunks().flatten().to_numpy()
        codes, doc = coded.indices.to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
        by = np.argsort(codes, kind="stable")
        self.docs = doc[by]
        self.impacts = impacts(tf, docs.column("n").to_numpy()[doc], n_docs, length)[by]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))]).astype(np.int64)
        self.most = np.maximum.reduceat(self.impacts, self.ends[:-1]) if len(self.impacts) else np.zeros(0, np.int64)
        self.number = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}
        self.edges = np.arange(0, len(sizes) + WINDOW, WINDOW)
        self.cursors: dict[int, np.ndarray] = {}

    def cursor(self, term: int) -> np.ndarray:
        """Where each window begins in a term's list."""
        if term not in self.cursors:
            lo, hi = self.ends[term], self.ends[term + 1]
            self.cursors[term] = lo + np.searchsorted(self.docs[lo:hi], self.edges)
        return self.cursors[term]

    def search(self, terms: list[tuple[bytes, int]], top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the best documents for terms with their weights, best first."""
        known = sorted((int(w * self.most[self.number[t]]), w, self.number[t]) for t, w in terms if w > 0 and t in self.number)
        bounds = np.array([b for b, _, _ in known], np.int64)
        reach = np.concatenate([[0], np.cumsum(bounds)])  # what the terms below can add together
        best, scores, threshold = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for k in range(len(self.edges) - 1):
            first = int(np.searchsorted(reach, threshold, side="right")) - 1  # terms below never make a pivot
            if first >= len(known):
                break
            bound, score = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
            lists = []
            for b, w, term in known[first:]:
                at = self.cursor(term)
                span = slice(at[k], at[k + 1])
                here = self.docs[span] - self.edges[k]
                bound[here] += b
                lists.append((here, span, w))
            pivots = np.flatnonzero((bound > 0) & (bound + reach[first] > threshold))
            if not len(pivots):
                continue
            wanted = np.zeros(WINDOW, bool)
            wanted[pivots] = True
            for here, span, w in lists:
                hit = wanted[here]
                score[here[hit]] += w * self.impacts[span][hit]
            found = score[pivots]
            for i in range(first - 1, -1, -1):
                able = found + reach[i + 1] > threshold
                pivots, found = pivots[able], found[able]
                if not len(pivots):
                    break
                _, w, term = known[i]
                at = self.cursor(term)
                here = self.docs[at[k] : at[k + 1]] - self.edges[k]
                to = np.searchsorted(here, pivots)
                hit = np.flatnonzero(to < len(here))
                hit = hit[here[to[hit]] == pivots[hit]]
                found[hit] += w * self.impacts[at[k] + to[hit]]
            better = found > threshold
            best, scores = np.concatenate([best, pivots[better] + self.edges[k]]), np.concatenate([scores, found[better]])
            if len(best) >= top:
                order = np.lexsort((best, -scores))[:top]
                best, scores = best[order], scores[order]
                threshold = int(scores[-1])
        order = np.lexsort((best, -scores))
        return best[order], scores[order]


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The `top` documents (doc_id, text) with a score above 0 of each item (item_id, text): item_id, rank, doc_id, score."""
    require(docs, "doc_id", "text")
    require(items, "item_id", "text")
    scratch = Scratch(spark, "lexical")
    asked = scratch.save(counted(items.select("item_id", "text"), ["item_id"]).withColumn("item", F.monotonically_increasing_id()))
    terms = asked.select("item", "item_id", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("item", "item_id", F.col("t.terms").alias("term"), F.col("t.tfs").alias("times"))
    used = bytearray(BITS)  # at most BITS numbers
    for r in terms.select((F.crc32("term") % BITS).alias("bit")).distinct().collect():
        used[r.bit] = 1
    held = scratch.save(counted(docs.select("doc_id", "text"), ["doc_id"], bytes(used)))
    total = held.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings")).first()
    schema = T.StructType([T.StructField("item", T.LongType()), items.schema["item_id"], docs.schema["doc_id"], T.StructField("score", T.LongType())])
    target = pa.schema([("item", pa.int64()), ("at", pa.int64()), ("score", pa.int64())])
    n_docs, length = total.docs, total.length

    df = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weighted = terms.join(df, "term").select("item", "item_id", "term", (weight(n_docs, F.col("df")) * F.col("times")).alias("w"))
    shards = max(-(-total.postings // SHARD), min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + n_docs // FEW))
    questions = weighted.groupBy("item", "item_id").agg(F.collect_list(F.struct("term", "w")).alias("asked"))
    # items are dealt to blocks by a hash; with one block, documents go out once
    blocks = -(-asked.count() // ITEMS)
    block = F.pmod(F.xxhash64("item"), F.lit(max(blocks, 1)))
    questions = questions.withColumns({"block": block, "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))})
    dealt = held.where(F.size("terms") > 0).withColumns({"shard": F.pmod(F.xxhash64("doc_id", "terms"), F.lit(shards)).cast("int"), "block": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(blocks, 1) - 1).cast("bigint")))})

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[list, list, list, list]] = []
        if left.num_rows and right.num_rows:
            shard = Shard(left, n_docs, length)
            for item, item_id, asked in zip(*(right.column(c).to_pylist() for c in ("item", "item_id", "asked"))):
                at, scores = shard.search([(t["term"], t["w"]) for t in asked], top)
                out.append(([item] * len(at), [item_id] * len(at), shard.ids.take(pa.array(at)).to_pylist(), scores.tolist()))
        columns = [[x for part in out for x in part[i]] for i in range(4)]
        types = [target.field("item").type, right.schema.field("item_id").type, left.schema.field("doc_id").type, target.field("score").type]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

    heaps = dealt.groupBy("block", "shard").cogroup(questions.groupBy("block", "shard")).applyInArrow(answer, schema)
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return heaps.withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")

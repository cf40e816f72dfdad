"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

The graph has a node for each distinct vector, so copies never fill each
other's lists. Random projection trees, fitted on a bounded sample, give
first lists: each tree sends every vector to one leaf, and a leaf's vectors
are compared in one block; a leaf that the sample's cuts left too long is cut
on at the medians of its own vectors. NN-descent then joins neighbours of
neighbours: every node gathers its neighbours and those that have it as a
neighbour, and those that are better for each other than what they have are
told so. Rounds go on until they change less than `DELTA` of all entries.

A query starts from its own list and holds the best nodes found in a beam
that grows with the number of nodes. In each round it asks for the neighbours
of the nodes that are new in its beam. Nodes lie in buckets of about `BUCKET`,
dealt once into a bucketed table; in each round only the questions are
exchanged, and a bucket answers only what still enters a beam. The search ends
when no beam changes, which it must: beams only get better, so a node that
left one never comes back. Scores are in double precision on the original
vectors.

The lists of nodes that name a node are bounded to its best `K`, as in the
method; hubs are merged in two steps, by task and then by node.

Defined results: vectors that are null, empty or zero, or hold a null or a
non-finite component, take no part, nor do null ids. Vectors of each
dimension are searched on their own. A repeated vec_id counts once, with its
smallest vector. A query without candidates, and an empty table, give no row.
Extra columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from beatlake.llm.common import require
from beatlake.scratch import Scratch

K, TREES, LEAF, LEAF_K = 32, 20, 400, 16
DELTA, BUCKET = 0.1, 2048
#: Places of a beam for each doubling of the nodes.
BEAM = 13
#: Vectors that the trees are fitted on, and the most numbers among them.
SAMPLE, SAMPLE_NUMBERS = 20_000, 1 << 23
#: A leaf longer than this is cut.
WIDE = 4 * LEAF


def valid(vectors: DataFrame) -> DataFrame:
    require(vectors, "vec_id", "embedding")
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & e.isNotNull()).where(fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), e.alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def best(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each owner its k distinct ids of largest score, best first, ties to smaller ids."""
    order = np.lexsort((-scores, ids, owner))
    owner, ids, scores = owner[order], ids[order], scores[order]
    new = np.ones(len(ids), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])
    owner, ids, scores = owner[new], ids[new], scores[new]
    order = np.lexsort((ids, -scores, owner))
    owner, ids, scores = owner[order], ids[order], scores[order]
    start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, int)
    rank = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
    keep = rank < k
    return owner[keep], ids[keep], scores[keep]


GRAPH = "node bigint, ids array<bigint>, scores array<float>"


def listed(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    """A row of `GRAPH` for each run of an owner."""
    who, sizes = np.unique(owner, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), lists(ids, sizes, pa.int64()), lists(scores, sizes, pa.float32())], ["node", "ids", "scores"])


def merged(rows: DataFrame, k: int, by_task: bool = False) -> DataFrame:
    """Rows of `GRAPH`, several a node, to the k best of each; with `by_task` first within a task, so that hubs are small when they meet."""

    def cut(batches):
        for b in batches:
            sizes = np.diff(b.column("ids").offsets.to_numpy())
            owner = np.repeat(b.column("node").to_numpy(), sizes)
            yield listed(*best(owner, b.column("ids").flatten().to_numpy(), b.column("scores").flatten().to_numpy(), k))

    part = arrow(rows, cut, GRAPH) if by_task else rows
    gathered = part.groupBy("node").agg(F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("scores")).alias("scores"))
    return arrow(gathered, cut, GRAPH)


def fit_trees(sample: np.ndarray, trees: int, depth: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """For each tree a direction a level, and the medians of the sample in each cell of the level; beyond what the sample can tell, one for all."""
    out = []
    for t in range(trees):
        ways = np.random.default_rng(t).standard_normal((depth, sample.shape[1])).astype(np.float32)
        code, cuts = np.zeros(len(sample), np.int64), []
        for level in range(depth):
            p = sample @ ways[level]
            fine = 1 << level if (len(sample) >> level) >= 16 else 1
            cell = code if fine > 1 else np.zeros_like(code)
            at = np.full(fine, np.median(p), np.float32)
            order = np.argsort(cell, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                at[cell[group[0]]] = np.median(p[group])
            cuts.append(at)
            code = code * 2 + (p > at[cell])
        out.append((ways, cuts))
    return out


def leaf(x: np.ndarray, tree: tuple[np.ndarray, list[np.ndarray]]) -> np.ndarray:
    ways, cuts = tree
    code = np.zeros(len(x), np.int64)
    p = x @ ways.T
    for level, at in enumerate(cuts):
        code = code * 2 + (p[:, level] > (at[code] if len(at) > 1 else at[0]))
    return code


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows with equal keys, from sorted ones; a longer run than `most` comes in pieces."""
    held: pa.Table | None = None
    for b in batches:
        now = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        now = now.combine_chunks()
        change = np.zeros(now.num_rows, bool)
        for k in keys:
            v = now.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        ends = [0, *np.flatnonzero(change).tolist()]
        for a, z in zip(ends, ends[1:]):
            yield from now.slice(a, z - a).combine_chunks().to_batches()
        held = now.slice(ends[-1])
        while held.num_rows > most:
            yield from held.slice(0, most).combine_chunks().to_batches()
            held = held.slice(most)
    if held is not None and held.num_rows:
        yield from held.combine_chunks().to_batches()


def dealt(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order)


def halved(x: np.ndarray, scale: float) -> pa.Array:
    """Rows in half precision, scaled so that none overflows; only the graph is ranked by them."""
    return pa.array([r.tobytes() for r in (x.astype(np.float64) * scale).astype(np.float16)], pa.binary())


def whole(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(len(column), -1).astype(np.float32)


def first_lists(nodes: DataFrame, n: int, trees: int, scale: float, scratch: Scratch) -> DataFrame:
    """Lists from the random projection trees: GRAPH rows, one for each node and tree. Vectors travel in half precision."""
    d = nodes.select(F.size("v").alias("d")).first()["d"]
    rows = nodes.orderBy(F.xxhash64("node"), "node").limit(min(SAMPLE, max(64, SAMPLE_NUMBERS // d))).select("v").collect()
    depth = max(0, int(np.ceil(np.log2(n / LEAF)))) if n > LEAF else 0
    fitted = fit_trees(np.array([r["v"] for r in rows], np.float32), trees if depth else 1, depth)

    def send(batches):
        for b in batches:
            x = matrix(b.column("v")).astype(np.float32)
            half = halved(x, scale)
            for t, tree in enumerate(fitted):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t), pa.int32()), pa.array(leaf(x, tree)), b.column("node"), half], ["tree", "leaf", "node", "x"])

    def place(batches):
        for b in batches:
            x = matrix(b.column("v")).astype(np.float32)
            for t, tree in enumerate(fitted):
                leaves, sizes = np.unique(leaf(x, tree), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaves), t), pa.int32()), pa.array(leaves), pa.array(sizes)], ["tree", "leaf", "n"])

    def compare(batches):
        for b in runs(batches, ["tree", "leaf"], 2 * WIDE):
            if b.num_rows > 1:
                x, node = whole(b.column("x")), b.column("node").to_numpy()
                s = x @ x.T
                np.fill_diagonal(s, -np.inf)
                k = min(LEAF_K if depth else K, len(x) - 1)
                at = np.argpartition(-s, k - 1, axis=1)[:, :k]
                order = np.argsort(np.repeat(node, k), kind="stable")
                yield listed(np.repeat(node, k)[order], node[at].ravel()[order], np.take_along_axis(s, at, 1).ravel()[order])

    sent = arrow(nodes.select("node", "v"), send, "tree int, leaf bigint, node bigint, x binary")
    sizes = arrow(nodes.select("v"), place, "tree int, leaf bigint, n bigint").groupBy("tree", "leaf").agg(F.sum("n").alias("n"))
    long = scratch.save(sizes.where(F.col("n") > WIDE).select("tree", "leaf"))
    if long.isEmpty():
        return arrow(dealt(sent, ["tree", "leaf"]), compare, GRAPH)
    out = arrow(dealt(sent.join(long, ["tree", "leaf"], "left_anti"), ["tree", "leaf"]), compare, GRAPH)
    for short in cut_leaves(scratch.save(sent.join(long, ["tree", "leaf"], "left_semi")), scratch):
        out = out.unionByName(arrow(dealt(short, ["tree", "leaf"]), compare, GRAPH))
    return out


def cut_leaves(rows: DataFrame, scratch: Scratch) -> Iterator[DataFrame]:
    """Rows of long leaves in halves of halves, at the median along a random direction a level, until none is long; equal projections go by a hash."""
    level = 0
    while not rows.isEmpty():
        level += 1

        def project(batches, level=level):
            for b in batches:
                x, tree, p = whole(b.column("x")), b.column("tree").to_numpy(), np.zeros(b.num_rows, np.float32)
                for t in np.unique(tree):
                    p[tree == t] = x[tree == t] @ np.random.default_rng([level, int(t)]).standard_normal(x.shape[1]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], [*b.schema.names, "p"])

        flat = scratch.save(arrow(rows, project, "tree int, leaf bigint, node bigint, x binary, p float"))
        cuts = scratch.save(flat.groupBy("tree", "leaf").agg(F.percentile_approx("p", 0.5, 1000).alias("at")))
        side = F.when(F.col("p") == F.col("at"), F.pmod(F.xxhash64("node", F.lit(level)), F.lit(2))).otherwise((F.col("p") > F.col("at")).cast("bigint"))
        halves = scratch.save(flat.join(cuts, ["tree", "leaf"]).select("tree", F.xxhash64("leaf", side).alias("leaf"), "node", "x"))
        long = scratch.save(halves.groupBy("tree", "leaf").count().where(F.col("count") > WIDE).select("tree", "leaf"))
        yield halves.join(long, ["tree", "leaf"], "left_anti")
        rows = scratch.save(halves.join(long, ["tree", "leaf"], "left_semi"))


def descend(graph: DataFrame, halves: DataFrame) -> DataFrame:
    """What a round of NN-descent finds: rows of `GRAPH`. `halves` has node and its vector in half precision, as bytes."""
    edge = graph.select(F.col("node").alias("u"), F.explode(F.arrays_zip("ids", "scores")).alias("e")).select("u", F.col("e.ids").alias("w"), F.col("e.scores").alias("s"))
    back = edge.select(F.col("w").alias("node"), F.array("u").alias("ids"), F.array("s").alias("scores"))
    around = graph.unionByName(merged(back, K, by_task=True)).select(F.col("node").alias("v"), F.explode("ids").alias("a"))
    worst = graph.select("node", F.when(F.size("scores") >= K, F.array_min("scores")).otherwise(F.lit(float("-inf")).cast("float")).alias("least"))
    members = halves.join(worst, "node")
    sent = around.join(members, around.a == members.node).select("v", "a", "x", "least")

    def introduce(batches):
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for b in runs(batches, ["v"], 1 << 12):
            # a node can be there twice, as neighbour and as one that names v
            a, once = np.unique(b.column("a").to_numpy(), return_index=True)
            x = whole(b.column("x"))[once]
            s = x @ x.T
            np.fill_diagonal(s, -np.inf)
            i, j = np.nonzero(s > b.column("least").to_numpy()[once][:, None])
            found.append((a[i], a[j], s[i, j]))
            held += len(i)
            if held > 1 << 19:
                yield listed(*best(*map(np.concatenate, zip(*found)), K))
                found, held = [], 0
        if held:
            yield listed(*best(*map(np.concatenate, zip(*found)), K))

    return arrow(dealt(sent, ["v"]), introduce, GRAPH)


def build(spark: SparkSession, nodes: DataFrame, scratch: Scratch, n: int, trees: int = TREES, delta: float = DELTA) -> DataFrame:
    """The graph: node, ids and scores of its neighbours, best first."""

    def halve(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("node"), halved(matrix(b.column("v")), scale)], ["node", "x"])

    # a component is 1 at most
    scale = 1.0 / float(nodes.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0])
    graph = scratch.save(merged(first_lists(nodes, n, trees, scale, scratch), K))
    halves = scratch.save(arrow(nodes.select("node", "v"), halve, "node bigint, x binary"))
    while True:
        now = scratch.save(merged(graph.unionByName(descend(graph, halves)), K))
        before = graph.select("node", F.col("ids").alias("old"))
        moved = now.join(before, "node", "left").agg(F.sum(F.size(F.array_except("ids", F.coalesce("old", F.array().cast("array<bigint>"))))).alias("new"), F.sum(F.size("ids")).alias("all")).first()
        scratch.drop(graph)
        graph = now
        if not moved["all"] or moved["new"] <= delta * moved["all"]:
            return graph


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


# a node in its bucket: its neighbours, as many as it has
STORE = "bucket bigint, id bigint, v array<double>, ids array<bigint>"
# a query's question to a bucket: the nodes it asks for, and the least score that enters its beam
ASKED = "bucket bigint, q bigint, v array<double>, least double, ids array<bigint>"
# a query's state (kind 0) or a reply to it (kind 1); near has K neighbours for each of ids, -1 where there are fewer
REPLY = "q bigint, kind int, v array<double>, ids array<bigint>, scores array<double>, near array<bigint>, want array<bigint>"


class Lists:
    """Rows of a list column as slices of one flat array."""

    def __init__(self, column: pa.Array):
        self.at, self.flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.at[i] : self.at[i + 1]]


def packed(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    """Tuples of numbers and arrays to a batch."""
    columns = []
    for column, kind in zip(zip(*rows), types):
        if pa.types.is_list(kind):
            columns.append(lists(np.concatenate(column), np.array([len(x) for x in column]), kind.value_type))
        else:
            columns.append(pa.array(column, kind))
    return pa.RecordBatch.from_arrays(columns, names)


def flushed(rows: Iterator[tuple], types: list[pa.DataType], names: list[str], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Batches of about `most` numbers."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, np.ndarray))
        if size > most:
            yield packed(held, types, names)
            held, size = [], 0
    if held:
        yield packed(held, types, names)


NONE, NO_SCORES = np.zeros(0, np.int64), np.zeros(0)


def ask(state: DataFrame, buckets: int, beam: int) -> DataFrame:
    """Questions of each query, by bucket of what it wants."""

    def questions(batches):
        for b in batches:
            q, v, scores, want = b.column("q").to_pylist(), Lists(b.column("v")), Lists(b.column("scores")), Lists(b.column("want"))
            for i, who in enumerate(q):
                ids = want[i]
                if len(ids):
                    home = bucket_of(ids, buckets)
                    order = np.argsort(home, kind="stable")
                    least = float(scores[i][-1]) if len(scores[i]) >= beam else float("-inf")
                    for part in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
                        yield int(home[part[0]]), who, v[i], least, ids[part]

    return arrow(state, lambda batches: flushed(questions(batches), ASKED_TYPES, ASKED_NAMES), ASKED)


def answers(beam: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A bucket's nodes and the questions put to it, to replies."""

    def answer(nodes: pa.Table, asked: pa.Table) -> pa.Table:
        if not nodes.num_rows or not asked.num_rows:
            return pa.Table.from_batches([], REPLY_SHAPE)
        nodes, asked = (x.combine_chunks().to_batches()[0] for x in (nodes, asked))
        order = np.argsort(nodes.column("id").to_numpy())
        ids, x, lists_ = nodes.column("id").to_numpy()[order], matrix(nodes.column("v"))[order], Lists(nodes.column("ids"))
        near = np.full((len(ids), K), -1, np.int64)
        for row, i in enumerate(order):
            near[row, : len(lists_[i])] = lists_[i]
        who, least, v, wanted = asked.column("q").to_pylist(), asked.column("least").to_pylist(), Lists(asked.column("v")), Lists(asked.column("ids"))

        def replies():
            for i in range(asked.num_rows):
                at = np.searchsorted(ids, wanted[i])
                scores = x[at] @ v[i]
                good = np.flatnonzero(scores >= least[i])
                if len(good) > beam:
                    good = good[np.argpartition(-scores[good], beam - 1)[:beam]]
                if len(good):
                    yield who[i], 1, NO_SCORES, wanted[i][good], scores[good], near[at[good]].ravel(), NONE

        return pa.Table.from_batches(flushed(replies(), REPLY_TYPES, REPLY_NAMES), REPLY_SHAPE)

    return answer


def advances(beam: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted REPLY rows, a query's state first and its replies after, to the next state."""

    def finish(q, v, ids, scores, near):
        known = len(ids[0])
        all_ids, all_scores = np.concatenate(ids), np.concatenate(scores)
        # a node asked for again while it is in the beam counts once, as known
        once = np.sort(np.unique(all_ids, return_index=True)[1])
        top = once[np.lexsort((all_ids[once], -all_scores[once]))[:beam]]
        fresh = top[top >= known] - known
        new = np.setdiff1d(np.concatenate(near).reshape(-1, K)[fresh], np.append(all_ids[top], [q, -1])) if len(fresh) else NONE
        return q, 0, v, all_ids[top], all_scores[top], NONE, new

    def states(batches):
        now = None
        for b in batches:
            q, kind = b.column("q").to_pylist(), b.column("kind").to_pylist()
            v, ids, scores, near = (Lists(b.column(c)) for c in ("v", "ids", "scores", "near"))
            for i, who in enumerate(q):
                if kind[i] == 0:
                    if now is not None:
                        yield finish(*now)
                    now = (who, v[i].copy(), [ids[i].copy()], [scores[i].copy()], [])
                else:
                    now[2].append(ids[i].copy())
                    now[3].append(scores[i].copy())
                    now[4].append(near[i].copy())
        if now is not None:
            yield finish(*now)

    return lambda batches: flushed(states(batches), REPLY_TYPES, REPLY_NAMES)


def shape_of(ddl: str) -> tuple[list[pa.DataType], list[str]]:
    names = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}

    def kind(s: str) -> pa.DataType:
        return pa.list_(kind(s[6:-1])) if s.startswith("array<") else names[s]

    fields = [f.strip().split(" ") for f in ddl.split(",")]
    return [kind(t) for _, t in fields], [n for n, _ in fields]


ASKED_TYPES, ASKED_NAMES = shape_of(ASKED)
REPLY_TYPES, REPLY_NAMES = shape_of(REPLY)
REPLY_SHAPE = pa.schema(list(zip(REPLY_NAMES, REPLY_TYPES)))


def stored(spark: SparkSession, nodes: DataFrame, graph: DataFrame, scratch: Scratch, buckets: int) -> DataFrame:
    """The nodes as a table bucketed by `bucket`, so that a join on it leaves them where they are."""

    def place(batches):
        for b in batches:
            home = pa.array(bucket_of(b.column("node").to_numpy(), buckets))
            yield pa.RecordBatch.from_arrays([home, b.column("node"), b.column("v").cast(pa.list_(pa.float64())), b.column("ids")], ["bucket", "id", "v", "ids"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return scratch.bucketed(arrow(nodes.join(graph, "node").select("node", "v", "ids"), place, STORE), parts, "bucket")


def search(spark: SparkSession, graph: DataFrame, nodes: DataFrame, starts: DataFrame, scratch: Scratch, n: int, beam: int) -> DataFrame:
    """q, ids and scores (best first) of each query node in `starts.node`."""
    buckets = max(1, n // BUCKET)
    store = stored(spark, nodes, graph, scratch, buckets)
    own = starts.join(nodes, "node").join(graph, "node")
    none = F.array().cast("array<bigint>")
    state = scratch.save(own.select(F.col("node").alias("q"), F.lit(0).alias("kind"), F.col("v").cast("array<double>").alias("v"), none.alias("ids"), F.array().cast("array<double>").alias("scores"), none.alias("near"), F.col("ids").alias("want")))
    open_ = True
    while open_:
        replies = store.groupBy("bucket").cogroup(ask(state, buckets, beam).groupBy("bucket")).applyInArrow(answers(beam), REPLY)
        left = Observation()
        moved = arrow(dealt(state.unionByName(replies), ["q"], "kind"), advances(beam), REPLY)
        after = scratch.save(moved.observe(left, F.count(F.when(F.size("want") > 0, 1)).alias("n")))
        scratch.drop(state)
        state = after
        open_ = left.get["n"] > 0
    scratch.forget(store)
    return state.select("q", "ids", "scores")


def nearest(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 20, beam: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row that `is_query` (of vec_id) picks."""
    scratch = Scratch(spark, "ann")
    rows = scratch.save(valid(vectors))
    sizes = sorted(r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect())
    found = [nearest_of_size(spark, rows.where(F.size("v") == d) if len(sizes) > 1 else rows, is_query, k, beam, scratch) for d in sizes]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")


def nearest_of_size(spark: SparkSession, rows: DataFrame, is_query: Column, k: int, beam: int | None, scratch: Scratch) -> DataFrame:
    """`nearest` for vectors of one dimension, vec_id and v."""
    nodes = scratch.save(rows.groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    n = nodes.count()
    graph = build(spark, nodes, scratch, n) if n > 1 else None
    named = rows.join(nodes.where("copies > 1").select("v", "node"), "v").select("node", "vec_id")
    # of copies the k + 1 smallest ids are enough; first by task, so a vector that is everywhere is small when its ids meet
    some = named.groupBy("node", F.spark_partition_id().alias("part")).agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("some"))
    copies = scratch.save(some.groupBy("node").agg(F.slice(F.sort_array(F.flatten(F.collect_list("some"))), 1, k + 1).alias("members")))
    queries = scratch.save(rows.where(is_query).join(nodes.select("v", "node"), "v").select(F.col("vec_id").alias("query_id"), "node"))
    starts = queries.select("node").distinct()
    own = starts.join(nodes, "node").select(F.col("node").alias("q"), "node", F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x * x).alias("score"))
    found = own
    if graph is not None:
        wide = max(4 * k, beam or BEAM * int(np.ceil(np.log2(n))))
        hits = scratch.save(search(spark, graph, nodes.select("node", "v"), starts, scratch, n, wide))
        found = found.unionByName(hits.select("q", F.explode(F.arrays_zip("ids", "scores")).alias("e")).select("q", F.col("e.ids").alias("node"), F.col("e.scores").alias("score")))
    each = found.join(copies, "node", "left").select("q", "score", F.explode(F.coalesce("members", F.array("node"))).alias("vec_id"))
    # at most the beam's nodes times k + 1 a query
    top = each.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k + 1).alias("top"))
    mine = queries.join(top, queries.node == top.q).select("query_id", F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k).alias("top"))
    out = mine.select("query_id", F.posexplode("top").alias("i", "t"))
    return out.select("query_id", (F.col("i") + 1).alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.s")).alias("score"))

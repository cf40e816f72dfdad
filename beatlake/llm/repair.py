"""Cheapest repair of conversations, by a dynamic programme over macro edits.

Every row is kept, given another role, or deleted, and empty turns may be
inserted, so that the roles' initials read `(s?(ua)+)?`. A row without words
or one said before must go. The cheapest edits win, and among equally cheap
ones those whose initials (Keep, Rerole, Delete, Insert) come first in ASCII.

A macro edit is a run of inserts and the edit of one row. Their codes
(`CODES`: I*K, I*R, I*D) are prefix-free and listed in order, so two
different audits of the same rows compare like their codes, one by one. The
programme therefore holds no strings: a layer has, for each of four states of
the grammar, the least cost, the rank of its audit among the layer's, the
state it came from and the code. A candidate compares by cost, its parent's
rank and its code; the audit is read off the parents at the end.

A conversation may have any number of rows. Rows are range-partitioned and
sorted by conversation and turn, and cut into blocks of bounded size. Each
block is solved from each of the four states on its own (`Block`); costs
and ranks at its ends are all that a scan over the conversation's blocks
needs to choose among them; then each block reads off its own edits. What was
said before is found by a grouping on content, so no task holds a
conversation; only blocks' summaries, and digests that are sequential by
nature, go through one task a conversation, as a stream.

Defined results: null role or text counts as one space, and a role outside
s, u, a can't be kept. Rows go by turn, nulls first, then by role and text.
Repeated rows are duplicates of the first. conv_id may be null, which is a
conversation of its own. Empty tables give none; columns of other names are
not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from beatlake.llm.common import map_rows, require, slices
from beatlake.scratch import Scratch

#: Rows and bytes of a block; a longer text is a block of its own.
ROWS, BYTES = 256, 1 << 21
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Macro edits in ASCII order; prefix-free. More than two inserts at a time never pay.
CODES = sorted("I" * n + e for n in range(3) for e in "KRD")
#: States of the grammar: nothing yet, after s, after u, after a; where an inserted turn leads from each.
STATES, NEXT = 4, (2, 2, 3, 2)
#: Inserts that end a conversation in each state.
END = (0, 2, 1, 0)
NEVER = 1 << 60
SPACE = " \t\n\v\f\r"
FINE, CUT, GONE = 0, 1, 2


@functools.lru_cache(None)
def moves(role: str, fault: int) -> list[tuple[int, int, int, int]]:
    """Macro edits of a row: from, code, to, cost."""
    out = []
    for state in range(STATES):
        for number, code in enumerate(CODES):
            at, cost = state, INSERT * (len(code) - 1)
            for _ in code[:-1]:
                at = NEXT[at]
            edit, late = code[-1], TRUNCATED * (fault == CUT)
            if edit == "D":
                out.append((state, number, at, cost + DELETE))
            elif fault != GONE and edit == "R":
                out.append((state, number, NEXT[at], cost + REROLE + late))
            elif fault != GONE and role == "s" and at == 0:
                out.append((state, number, 1, cost + KEEP + late))
            elif fault != GONE and role == ("a" if at == 2 else "u"):
                out.append((state, number, NEXT[at], cost + KEEP + late))
    return out


def layer(costs: list[int], ranks: list[int], steps: list[tuple[int, int, int, int]]) -> tuple[list[int], list[int], list[tuple[int, int] | None]]:
    """Costs, ranks and parents (state, code) after one more row."""
    best: list[tuple[int, int, int, int] | None] = [None] * STATES
    for state, code, to, cost in steps:
        if costs[state] < NEVER:
            found = (costs[state] + cost, ranks[state], code, state)
            if best[to] is None or found < best[to]:
                best[to] = found
    order = {x: i for i, x in enumerate(sorted((b[1], b[2]) for b in best if b))}
    return [b[0] if b else NEVER for b in best], [order[b[1], b[2]] if b else STATES for b in best], [(b[3], b[2]) if b else None for b in best]


#: Rows as the programme sees them: two characters a row, the role's initial and its fault.
@functools.lru_cache(1 << 16)
def solved(rows: str, entry: int) -> tuple[list[int], list[int], list[list[tuple[int, int] | None]]]:
    """Costs and ranks of the states after a block that is entered in `entry`, and every layer's parents."""
    costs, ranks, parents = [NEVER] * STATES, [STATES] * STATES, []
    costs[entry] = ranks[entry] = 0
    for i in range(0, len(rows), 2):
        costs, ranks, back = layer(costs, ranks, moves(rows[i], int(rows[i + 1])))
        parents.append(back)
    return costs, ranks, parents


def audit(rows: str, entry: int, leave: int) -> list[str]:
    """The codes of a block's rows between two states, read off the parents."""
    out = []
    for back in reversed(solved(rows, entry)[2]):
        leave, code = back[leave]
        out.append(CODES[code])
    return out[::-1]


def chained(costs: list[int], ranks: list[int], block_costs: list[int], block_ranks: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Costs, ranks and entry states of the best ways through one more block; the block's lists have a row of four for each entry."""
    found = []
    for to in range(STATES):
        ways = [(costs[e] + block_costs[e * STATES + to], ranks[e], block_ranks[e * STATES + to], e) for e in range(STATES) if costs[e] < NEVER and block_costs[e * STATES + to] < NEVER]
        found.append(min(ways, default=None))
    order = {x: i for i, x in enumerate(sorted((w[1], w[2]) for w in found if w))}
    return [w[0] if w else NEVER for w in found], [order[w[1], w[2]] if w else STATES for w in found], [w[3] if w else -1 for w in found]


def blocks(turns: DataFrame) -> DataFrame:
    """conv_id, block (ascending in a conversation), turns, roles, texts: the rows in order, in pieces of bounded size."""
    keys = ["conv_id", "turn", "role", "text"]
    rows = turns.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    kinds = [turns.schema["conv_id"], T.StructField("block", T.LongType()), T.StructField("turns", T.ArrayType(turns.schema["turn"].dataType)), *(T.StructField(c, T.ArrayType(T.StringType())) for c in ("roles", "texts"))]
    schema = T.StructType(kinds)
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now, size, begun = TaskContext.get().partitionId() << 33, None, 0, False
        held: tuple[list, list, list] = ([], [], [])
        out: list[tuple] = []
        total = 0

        def close() -> None:
            nonlocal number, held, size, total
            out.append((now, number, *held))
            number, held, total, size = number + 1, ([], [], []), total + size, 0

        def flush() -> pa.RecordBatch:
            nonlocal total
            columns = list(zip(*out))
            out.clear()
            total = 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, target.types)], schema=target)

        for batch in batches:
            for part in slices(batch):
                for conv, *row in zip(*(part.column(i).to_pylist() for i in range(4))):
                    if held[0] and (conv != now or len(held[0]) >= ROWS or size >= BYTES):
                        close()
                    now = conv
                    for column, value in zip(held, row):
                        column.append(value)
                    size += len(row[2])
                if out and (total > 2 * BYTES or len(out) >= 4096):
                    yield flush()
        if held[0]:
            close()
        if out:
            yield flush()

    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def said_before(blocks: DataFrame) -> DataFrame:
    """block and places: the rows of each block whose role and text an earlier row of the conversation has."""
    rows = blocks.select("conv_id", "block", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "row"))
    content = F.unhex(F.sha2(F.concat(F.length("row.roles").cast("string"), F.lit(":"), F.col("row.roles"), F.col("row.texts")), 256))
    at = F.struct("block", "place")
    rows = rows.select("conv_id", content.alias("content"), at.alias("at"))
    first = rows.groupBy("conv_id", "content").agg(F.min("at").alias("first"), F.count("*").alias("times")).where("times > 1")
    r, f = rows.alias("r"), first.alias("f")
    again = r.join(f, F.col("r.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("r.content") == F.col("f.content")) & (F.col("r.at") != F.col("f.first")))
    return again.groupBy(F.col("r.at.block").alias("block")).agg(F.collect_list("r.at.place").alias("places"))


def initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "-"


COUNTS = ("blank", "duplicate", "truncated", "illegal")
MARKS = ("first_initial", "last_initial")
FOLLOWS = {"su", "ua", "au"}


def summaries(blocks: DataFrame, repeated: DataFrame) -> DataFrame:
    """A row a block: its rows as the programme sees them, costs and ranks between states, counts of faults, and what adjoins the next block."""
    turn = blocks.schema["turns"].dataType.elementType
    number = T.ArrayType(T.LongType())
    fields = [blocks.schema["conv_id"], blocks.schema["block"], T.StructField("seen", T.StringType()), T.StructField("costs", number), T.StructField("ranks", number), *(T.StructField(c, T.LongType()) for c in COUNTS), *(T.StructField(c, T.StringType()) for c in MARKS), T.StructField("low", turn), T.StructField("high", turn), T.StructField("n_turns", T.LongType())]

    def make():
        def one(conv, block, turns, roles, texts, places):
            again, seen, counts = set(places or ()), [], dict.fromkeys(COUNTS, 0)
            for i, (role, text) in enumerate(zip(roles, texts)):
                words = text.rstrip(SPACE)
                fault = "blank" if not words else "duplicate" if i in again else "truncated" if words[-1] not in ".!?" else None
                if fault:
                    counts[fault] += 1
                seen.append(initial(role) + str(CUT if fault == "truncated" else GONE if fault else FINE))
                if i and roles[i - 1][:1] + role[:1] not in FOLLOWS:
                    counts["illegal"] += 1
            rows = "".join(seen)
            ends = [solved(rows, e) for e in range(STATES)]
            known = [t for t in turns if t is not None]
            yield (conv, block, rows, [c for e in ends for c in e[0]], [r for e in ends for r in e[1]], *counts.values(),
                   roles[0][:1], roles[-1][:1], min(known, default=None), max(known, default=None), len(set(known)))

        return one

    rows = blocks.join(repeated, "block", "left")
    return map_rows(rows, ["conv_id", "block", "turns", "roles", "texts", "places"], T.StructType(fields), make)


def chosen(summary: DataFrame) -> DataFrame:
    """block, seen, entry and leave: the states between which each block's edits lead, by a scan over each conversation's blocks."""
    schema = pa.schema([("block", pa.int64()), ("seen", pa.string()), ("entry", pa.int32()), ("leave", pa.int32()), ("is_last", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []
        costs, ranks = [0, NEVER, NEVER, NEVER], [0, STATES, STATES, STATES]
        out: list[tuple] = []

        def trace() -> None:
            state = min((costs[s] + INSERT * END[s], ranks[s], s) for s in range(STATES) if costs[s] < NEVER)[2]
            last = True
            for block, seen, entries in reversed(blocks):
                out.append((block, seen, entries[state], state, last))
                state, last = entries[state], False

        for batch in batches:
            for conv, block, seen, block_costs, block_ranks in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if blocks and conv != now:
                    trace()
                    blocks, costs, ranks = [], [0, NEVER, NEVER, NEVER], [0, STATES, STATES, STATES]
                now = conv
                costs, ranks, entries = chained(costs, ranks, block_costs, block_ranks)
                blocks.append((block, seen, entries))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out = []
        if blocks:
            trace()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    given = summary.select("conv_id", "block", "seen", "costs", "ranks")
    return given.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(run, "block bigint, seen string, entry int, leave int, is_last boolean")


TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def edited(blocks: DataFrame, choice: DataFrame) -> DataFrame:
    """conv_id, block, audit, cost and turns (role, text) as repaired, of each block."""
    schema = T.StructType([blocks.schema["conv_id"], blocks.schema["block"], T.StructField("audit", T.StringType()), T.StructField("cost", T.LongType()), T.StructField("turns", TURNS)])

    def make():
        def one(conv, block, roles, texts, rows, entry, leave, is_last):
            state, codes, turns, cost = entry, audit(rows, entry, leave), [], 0
            name = lambda: "assistant" if state == 2 else "user"
            for i, code in enumerate(codes):
                for edit in code:
                    if edit == "I":
                        turns.append((name(), ""))
                        cost += INSERT
                    elif edit == "D":
                        cost += DELETE
                        continue
                    else:
                        turns.append((roles[i] if edit == "K" else name(), texts[i]))
                        cost += (REROLE if edit == "R" else KEEP) + TRUNCATED * (rows[2 * i + 1] == str(CUT))
                    state = 1 if turns[-1][0][:1] == "s" else NEXT[state]
            for _ in range(END[state] if is_last else 0):
                codes.append("I")
                turns.append((name(), ""))
                cost += INSERT
                state = NEXT[state]
            yield conv, block, "".join(codes), cost, turns

        return one

    rows = blocks.join(choice, "block")
    return map_rows(rows, ["conv_id", "block", "roles", "texts", "seen", "entry", "leave", "is_last"], schema, make)


class Repair:
    """The repair of all conversations in `turns` (conv_id, turn, role, text): `edits`, a row a block, and `summary` of what was found in it."""

    def __init__(self, spark: SparkSession, turns: DataFrame):
        require(turns, "conv_id", "turn", "role", "text")
        scratch = Scratch(spark, "repair")
        cut = scratch.save(blocks(turns))
        self.summary = scratch.save(summaries(cut, said_before(cut)))
        self.edits = edited(cut, chosen(self.summary))

    def turns(self) -> DataFrame:
        """The repaired rows: conv_id, block, place (ascending in a conversation), role, text."""
        return self.edits.select("conv_id", "block", F.posexplode("turns").alias("place", "turn")).select("conv_id", "block", "place", "turn.*")

    def conversations(self) -> DataFrame:
        """A row a conversation: gaps in the turns, counts of faults, cost, audit, and the digest of the repaired rows."""
        found = self.summary.select("conv_id", "block", *COUNTS, *MARKS, "low", "high", "n_turns").withColumnRenamed("block", "of")
        pieces = self.edits.select(F.col("block"), "audit", "cost", F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])).alias("lines"))
        rows = found.join(pieces, found.of == pieces.block).drop("of")
        names = ("gaps", *COUNTS, "cost")
        schema = T.StructType([found.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in names), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
        target = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            now, open_ = None, False

            def close() -> None:
                gaps = high - low + 1 - distinct if low is not None else 0
                out.append((now, gaps, *counts, cost, "".join(audits), sha.hexdigest()))

            for batch in batches:
                for conv, _, *faults, first, last, lo, hi, n, piece, paid, lines in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                    if open_ and conv != now:
                        close()
                        open_ = False
                    if not open_:
                        now, open_, counts, cost, audits, sha = conv, True, [0] * len(COUNTS), 0, [], hashlib.sha256()
                        before, low, high, distinct, empty = None, None, None, 0, True
                    counts = [a + b for a, b in zip(counts, faults)]
                    counts[-1] += before is not None and before + first not in FOLLOWS
                    before, cost = last, cost + paid
                    if lo is not None:
                        distinct += n - (high is not None and lo == high)
                        low, high = lo if low is None else low, hi
                    audits.append(piece)
                    for line in lines:
                        sha.update(("" if empty else "\n").encode() + line.encode("utf-8", "surrogatepass"))
                        empty = False
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), target.types)], schema=target)
                    out = []
            if open_:
                close()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), target.types)], schema=target)

        columns = ["conv_id", "block", *COUNTS, *MARKS, "low", "high", "n_turns", "audit", "cost", "lines"]
        return rows.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(run, schema)

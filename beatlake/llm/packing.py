"""Packing token sequences by vector bin packing.

A sequence is a bin with three limits: tokens, segments (pieces) and
loss-bearing tokens. A piece is an item with a demand on each. Documents
longer than a sequence first fill whole sequences of their own; what is left
of them, and all shorter documents, wait in a window of items that holds a
bin's tokens at least. A bin takes,
among the items that fit, the one whose demand has the largest dot product
with what the bin has left (both as shares of the limits), until none fits;
then the waiting item of which most tokens fit is cut to fill it. A bin that
segments or loss-bearing tokens close stays as it is; only what is left at the
end of a partition is cut to sequences whose lengths are powers of two and
need no padding.

Each partition packs its own documents in one streaming pass: no shuffle,
no state beyond the window, and a lost executor repeats its partition alone.
A waiting item holds only what is left of its document. Sequence ids carry the
partition in their upper bits.

Loss-bearing tokens of a piece are all but its first one (which nothing
precedes), unless `pack` is given a column of loss spans, such as those of
chat turns: then they are the tokens that overlap a span, and the end token
if a span reaches the end of the text. Without spans a loss limit below the
token limit only makes sequences shorter, so the default leaves it open.

Defined results: null and empty texts are a document of the end token alone.
Repeated rows are packed once each. Special strings in a text become the ids
that the tokenizer gives them. An empty table gives no piece. Extra columns of
any name are not read, but for the one that `loss` names.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatlake.llm.common import require, slices

END = 2
#: Distinct words and chunks that a worker remembers.
REMEMBER = 1_500_000
PART_BITS = 36


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    #: None: as many as there are tokens, so this never closes a bin.
    segments: int | None = None
    loss: int = 4096
    #: Items that wait for a place, or more where they don't hold the tokens of a bin.
    window: int = 512

    @property
    def caps(self) -> tuple[int, int, int]:
        return self.tokens, self.tokens if self.segments is None else self.segments, self.loss


def latin(*major: str, but: str = "") -> str:
    """The characters below U+0180 whose general category starts with one of `major`, for a character class."""
    return "".join(f"\\u{c:04x}" for c in range(0x180) if unicodedata.category(chr(c))[0] in major and chr(c) not in but)


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    A text of Latin letters and marks is cut into the tokenizer's pre-tokens
    here, and each is looked up; distinct ones are encoded in large calls.
    For other texts the same goes for what stands between white space, which
    no pre-token crosses.
    """

    # Fixed value: the tokenizer's pre-token pattern, for texts of characters below U+0180.
    PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{latin('L')}]+|[{latin('N')}]|[^\s{latin('L', 'N')}]+")
    #: No control or format characters, nothing that lower-cases to more than itself, and no special string.
    PLAIN = re.compile(rf"[ \t\n\r{latin('L', 'N', 'P', 'S', but='<\u0130\u0149')}]*")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Encodes words that are one pre-token each in one call; word numbers tell where each ends."""
        got = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        cuts = (np.searchsorted(np.array(got.word_ids), np.arange(len(words) + 1)) * 4).tolist()
        raw = np.array(got.ids, "<u4").tobytes()
        self.words.update(zip(words, map(raw.__getitem__, map(slice, cuts[:-1], cuts[1:]))))

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        if len(self.words) + len(self.chunks) > REMEMBER:
            self.words.clear()
            self.chunks.clear()
        out: list[list[bytes | None]] = []
        late: list[tuple[int, list[str]]] = []
        for n, raw in enumerate(texts):
            text = (raw or b"").decode()
            if self.PLAIN.fullmatch(text):
                found = self.PRETOKEN.findall(text.lower())
                out.append(list(map(self.words.get, found)))
                if None in out[-1]:
                    late.append((n, found))
            else:
                chunks = raw.split()
                self.chunks.update((c, self.ids(c.decode())) for c in set(chunks) - self.chunks.keys())
                out.append(list(map(self.chunks.__getitem__, chunks)))
        missing = list({w for n, found in late for w, ids in zip(found, out[n]) if ids is None})
        for at in range(0, len(missing), 8192):
            self.learn(missing[at : at + 8192])
        for n, found in late:
            out[n] = [self.words[w] if ids is None else ids for w, ids in zip(found, out[n])]
        return list(map(b"".join, out))

    def masked(self, raw: bytes | None, spans: list[dict]) -> tuple[bytes, np.ndarray]:
        """Ids of one text, and which tokens and end token overlap spans of its code points."""
        text = (raw or b"").decode()
        got = self.tokenizer.encode(text, add_special_tokens=False)
        at = np.array(got.offsets, np.int64).reshape(-1, 2)
        loss = np.zeros(len(at) + 1, bool)
        for s in spans:
            if s["start"] < s["end"]:
                loss[:-1] |= (at[:, 0] < s["end"]) & (at[:, 1] > s["start"])
                loss[-1] |= s["end"] >= len(text)
        return np.array(got.ids, "<u4").tobytes(), loss


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, so what it remembers serves later tasks too."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


@dataclass
class Item:
    """What is left of a document: its key, its ids (4 bytes each), where they start in it, and its number of tokens."""

    key: object
    ids: bytes
    total: int
    start: int = 0
    #: Running counts of loss-bearing tokens, or None where all but the first token of a piece bear loss.
    loss: np.ndarray | None = None
    #: Tokens of `ids` that are packed.
    at: int = 0
    #: Tokens, segments and loss-bearing tokens of all that is left, while it waits.
    need: tuple[int, int, int] = (0, 0, 0)

    @property
    def length(self) -> int:
        return len(self.ids) // 4 - self.at

    def base(self) -> int:
        return int(self.loss[self.at - 1]) if self.at else 0

    def loss_of(self, n: int) -> int:
        return n - 1 if self.loss is None else int(self.loss[self.at + n - 1]) - self.base()

    def most(self, tokens: int, loss: int) -> int:
        """The most tokens that keep both."""
        n = min(self.length, tokens)
        if self.loss is None:
            return min(n, loss + 1)
        return min(n, int(np.searchsorted(self.loss[self.at : self.at + n], self.base() + loss, side="right")))

    def take(self, n: int) -> tuple:
        """key, start, ids and the document's tokens of the next n."""
        piece = self.key, self.start + self.at, self.ids[4 * self.at : 4 * (self.at + n)], self.total
        self.at += n
        return piece

    def rest(self) -> Item:
        """The same without what is packed."""
        loss = None if self.loss is None else self.loss[self.at :] - self.base()
        return Item(self.key, self.ids[4 * self.at :], self.total, self.start + self.at, loss)


@dataclass
class Packer:
    limits: Limits = field(default_factory=Limits)
    first: int = 0
    waiting: list[Item] = field(default_factory=list)

    def __post_init__(self):
        self.next, self.held = self.first, 0

    def add(self, item: Item) -> Iterator[list[tuple]]:
        """Full sequences of one document, then bins as long as too many items wait."""
        while item.length >= self.limits.tokens and item.loss_of(self.limits.tokens) <= self.limits.loss:
            yield self.close([item.take(self.limits.tokens)])
        if item.length:
            self.wait(item.rest() if item.at else item)
        tokens, segments, _ = self.limits.caps
        while len(self.waiting) > self.limits.window and (self.held >= tokens or len(self.waiting) >= segments):
            yield from self.fill()

    def wait(self, item: Item) -> None:
        n = item.length
        item.need = n, 1, item.loss_of(n)
        self.waiting.append(item)
        self.held += n

    def close(self, pieces: list[tuple]) -> list[tuple]:
        """The pieces with their sequence and offset."""
        out, at = [], 0
        for key, start, ids, total in pieces:
            out.append((key, start, ids, total, self.next, at))
            at += len(ids) // 4
        self.next += 1
        return out

    def fill(self) -> Iterator[list[tuple]]:
        """One bin by the dot-product heuristic over the waiting items."""
        cap = np.array(self.limits.caps, float)
        demand = np.array([i.need for i in self.waiting], float)
        left, free, pieces = cap.copy(), np.ones(len(demand), bool), []
        while True:
            # the last segment is kept for a cut that fills the bin
            fits = free & (demand <= left).all(1) & ((left[1] > 1) | (demand[:, 0] == left[0]))
            if not fits.any():
                break
            at = int(np.argmax(np.where(fits, (demand / np.maximum(cap, 1)) @ (left / np.maximum(cap, 1)), -1.0)))
            pieces.append(self.waiting[at].take(self.waiting[at].length))
            left -= demand[at]
            free[at] = False
        rest = np.flatnonzero(free)
        if left[0] and left[1] and len(rest):
            if left[2] >= left[0]:  # loss can't bind
                longest = np.minimum(demand[rest, 0], left[0]).astype(int)
            else:
                longest = np.array([self.waiting[i].most(int(left[0]), int(left[2])) for i in rest])
            at = int(np.argmax(longest))
            if longest[at]:
                pieces.append(self.waiting[rest[at]].take(int(longest[at])))
                left[0] -= longest[at]
            elif not pieces:
                # a token that bears loss, where none may: alone, so that no token is lost
                pieces.append(self.waiting[rest[0]].take(1))
        self.waiting, self.held, left_over = [], 0, [self.waiting[i] for i in rest]
        for item in left_over:
            if not item.at:
                self.waiting.append(item)
                self.held += item.need[0]
            elif item.length:
                self.wait(item.rest())
        if self.waiting or not left[0]:
            yield self.close(pieces)
        else:
            yield from self.powers(pieces)

    def powers(self, pieces: list[tuple]) -> Iterator[list[tuple]]:
        """The pieces in sequences whose lengths are powers of two."""
        total = sum(len(p[2]) // 4 for p in pieces)
        while total:
            size, taken, now = 1 << (total.bit_length() - 1), 0, []
            while taken < size:
                key, start, ids, of = pieces.pop(0)
                use = min(len(ids) // 4, size - taken)
                now.append((key, start, ids[: 4 * use], of))
                if 4 * use < len(ids):
                    pieces.insert(0, (key, start + use, ids[4 * use :], of))
                taken += use
            total -= size
            yield self.close(now)

    def finish(self) -> Iterator[list[tuple]]:
        while self.waiting:
            yield from self.fill()


PIECES = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


def pack(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end: int = END, loss: str | None = None) -> DataFrame:
    """doc_id and the pieces of every row: start, length, ids (32-bit little-endian), doc_tokens, sequence_id, offset.

    `loss` names a column of arrays of (start, end), the loss-bearing spans in
    code points of text; where it is null, the row counts as without spans.
    """
    require(docs, "doc_id", "text", *([loss] if loss else []))
    schema = T.StructType([docs.schema["doc_id"], *PIECES])
    names = schema.names
    tail = np.array([end], "<u4").tobytes()
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer), Packer(limits, first=TaskContext.get().partitionId() << PART_BITS)
        out: list[tuple] = []
        size = 0

        def emit(sequences: Iterator[list[tuple]]) -> None:
            nonlocal size
            for pieces in sequences:
                for doc_id, start, ids, total, sequence, offset in pieces:
                    out.append((doc_id, start, len(ids) // 4, ids, total, sequence, offset))
                    size += len(ids) // 4

        def flush() -> pa.RecordBatch:
            nonlocal size
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), target.types)], schema=target)
            out.clear()
            size = 0
            return made

        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                spans = part.column(2).to_pylist() if loss else [None] * len(texts)
                plain = iter(encode([t for t, s in zip(texts, spans) if s is None]))
                for doc_id, text, s in zip(part.column(0).to_pylist(), texts, spans):
                    raw, mask = (next(plain), None) if s is None else encode.masked(text, s)
                    raw += tail
                    emit(packer.add(Item(doc_id, raw, len(raw) // 4, loss=None if mask is None else np.cumsum(mask))))
                if size > 1 << 20:
                    yield flush()
        emit(packer.finish())
        if out:
            yield flush()

    spans = [F.transform(F.col(f"`{loss}`"), lambda s: F.struct(s["start"].cast("bigint").alias("start"), s["end"].cast("bigint").alias("end"))).alias("spans")] if loss else []
    return docs.select("doc_id", F.col("text").cast("binary").alias("raw"), *spans).mapInArrow(run, schema).select(*names)

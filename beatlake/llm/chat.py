"""Chat formatting with typed content parts.

A message is a list of typed parts. A visitor flattens them in order: text is
escaped and copied; an image, audio or document part becomes a placeholder
with its number in the conversation, its reference is recorded, and its
tokens are counted by its extent (image tiles, audio seconds, pages).

A turn is written as `### <role>:`, a line end, the content, `</turn>` and a
line end. Inside roles and texts a backslash goes before every backslash and
before whatever would start a control string, so the output can be read back
to the same turns. Text parts that follow one another are escaped as one, so
no control string can be put together from pieces; they are read back as one.
The loss mask is a list of spans of the output, one for each assistant text.

Rows are sorted by conversation and turn within hash partitions and formatted
in one pass, so a task holds one conversation's output at a time, never all
of a partition. A conversation is one row of the result, so the longest one
(that of a null conv_id, too) must fit a task's memory.

Defined results: null role, text or parts count as empty; rows of equal turn
are ordered by role, then text, null turns first; repeated rows are turns of
their own. A null conv_id is a conversation. Unknown part types are text.
An empty table gives no conversation. Extra columns, whatever their names,
are not read: typed parts only from the column that `parts` names.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from beatlake.llm.common import map_rows, require, slices

# The template's control strings.
OPEN, CLOSE, ATTACH, END = "### ", "</turn>", "<|", "\n"
IMAGE_TILE, IMAGE_TOKENS, AUDIO_RATE, PAGE_TOKENS = 512, 170, 25, 500
TEXT, ATTACHED = "text", ("image", "audio", "document")
SPECIAL = re.compile(r"\\|### |</turn>|<\|")
UNESCAPE = re.compile(r"\\(.)", re.S)

PART = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("pages", T.LongType()),
    ]
)
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
ATTACHMENT = T.StructType([T.StructField("number", T.LongType()), T.StructField("type", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("at", T.LongType()), T.StructField("tokens", T.LongType())])


def escape(text: str, more: str = "") -> str:
    """Reversible: every backslash and every start of a control string (and each character of `more`) gets a backslash."""
    text = SPECIAL.sub(lambda m: "\\" + m[0], text)
    return re.sub(f"[{re.escape(more)}]", lambda m: "\\" + m[0], text) if more else text


def unescape(text: str) -> str:
    return UNESCAPE.sub(lambda m: m[1], text)


class Visitor:
    """Writes one conversation; a method for each part type."""

    def __init__(self):
        self.out: list[str] = []
        self.size = 0
        self.loss: list[tuple[int, int]] = []
        self.attachments: list[tuple] = []

    def write(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def turn(self, role: str | None, parts: list[dict]) -> None:
        self.write(f"{OPEN}{escape(role or '', ':')}:{END}")
        for kind, group in itertools.groupby(parts, key=self.kind):
            start = self.size
            if kind == TEXT:
                self.visit_text("".join(p.get("text") or "" for p in group))
                if role == "assistant" and self.size > start:
                    self.loss.append((start, self.size))
            else:
                for part in group:
                    getattr(self, f"visit_{kind}")(part)
        self.write(f"{CLOSE}{END}")

    @staticmethod
    def kind(part: dict) -> str:
        return part.get("type") if part.get("type") in ATTACHED else TEXT

    def visit_text(self, text: str) -> None:
        self.write(escape(text))

    def attach(self, part: dict, tokens: int) -> None:
        number = len(self.attachments)
        self.attachments.append((number, part["type"], part.get("ref"), self.size, tokens))
        self.write(f"{ATTACH}{part['type']}:{number}|>")

    def visit_image(self, part: dict) -> None:
        tiles = math.prod(max(1, -(-(part.get(k) or 1) // IMAGE_TILE)) for k in ("width", "height"))
        self.attach(part, tiles * IMAGE_TOKENS)

    def visit_audio(self, part: dict) -> None:
        self.attach(part, math.ceil((part.get("seconds") or 0) * AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self.attach(part, (part.get("pages") or 0) * PAGE_TOKENS)


def format_conversations(turns: DataFrame, parts: str | None = None) -> DataFrame:
    """One row a conversation: conv_id, formatted, loss (spans), attachments.

    `turns` has conv_id, turn, role, and text; or `parts` names a column of arrays of `PART`.
    """
    typed, content = parts is not None, parts or "text"
    require(turns, "conv_id", "turn", "role", content)
    schema = T.StructType([turns.schema["conv_id"], T.StructField("formatted", T.StringType()), T.StructField("loss", T.ArrayType(SPAN)), T.StructField("attachments", T.ArrayType(ATTACHMENT))])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, visitor, size = None, None, 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            as_rows = lambda names, rows: [[dict(zip(names, x)) for x in row] for row in rows]
            arrays = [columns[0], columns[1], as_rows(SPAN.names, columns[2]), as_rows(ATTACHMENT.names, columns[3])]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, target.types)], schema=target)

        for batch in batches:
            for part in slices(batch):
                for conv_id, role, body in zip(*(part.column(i).to_pylist() for i in range(3))):
                    if visitor is None or conv_id != now:
                        if visitor is not None:
                            out.append((now, "".join(visitor.out), visitor.loss, visitor.attachments))
                            size += visitor.size
                        now, visitor = conv_id, Visitor()
                    visitor.turn(role, (body or []) if typed else [{"type": "text", "text": body}])
                if size > 1 << 22:
                    yield flush()
                    size = 0
        if visitor is not None:
            out.append((now, "".join(visitor.out), visitor.loss, visitor.attachments))
        if out:
            yield flush()

    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ties = ["role"] if typed else ["role", "text"]
    dealt = turns.select("conv_id", "turn", "role", content).repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", *ties)
    return dealt.select("conv_id", "role", content).mapInArrow(run, schema)


ROLE = re.compile(r"### ((?:[^\\:]|\\.)*+):\n", re.S)
#: A run of text, a placeholder, or the end of the turn; texts hold no bare control string.
CONTENT = re.compile(r"(?P<text>(?:[^\\<]|\\.|<(?!/turn>\n|\|))++)|<\|(?P<type>[a-z]+):(?P<number>[0-9]+)\|>|(?P<end></turn>\n)", re.S)


def read_turns(formatted: str) -> list[tuple[str, list[tuple[str, str | int]]]]:
    """Role and parts of each turn of a formatted conversation: (`text`, unescaped) or (type, number of the attachment)."""
    out, at = [], 0
    while at < len(formatted):
        role = ROLE.match(formatted, at)
        if not role:
            raise ValueError(f"no turn at {at}")
        parts: list[tuple[str, str | int]] = []
        at = role.end()
        while True:
            found = CONTENT.match(formatted, at)
            if not found:
                raise ValueError(f"no content at {at}")
            at = found.end()
            if found["end"]:
                break
            parts.append((TEXT, unescape(found["text"])) if found["text"] else (found["type"], int(found["number"])))
        out.append((unescape(role[1]), parts))
    return out


def text_of(parts: list[tuple[str, str | int]]) -> str:
    return "".join(str(v) for kind, v in parts if kind == TEXT)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what a reader of the output gets: turns, and text under the loss mask."""
    fields = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    schema = T.StructType([formatted.schema["conv_id"], *(T.StructField(f, T.StringType() if "sha" in f else T.LongType()) for f in fields)])
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def make():
        def one(conv_id, text, loss):
            turns = read_turns(text)
            learned = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
            yield conv_id, len(turns), sha("".join(f"{r}\n{text_of(p)}\n" for r, p in turns)), len(learned), sha(learned), len(text)

        return one

    return map_rows(formatted, ["conv_id", "formatted", "loss"], schema, make)

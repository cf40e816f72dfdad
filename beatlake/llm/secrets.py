"""Secrets in texts, with multipart credentials linked by an interval join.

Base spans (always reported) are assignments to a password-like name, access
key identifiers and long hexadecimal runs. The method adds weak parts, each
common in clean text, only where complementary parts stand together: a secret
body (a 40-character token with both cases and a digit) or an endpoint (a
host name with a port, or a URL with a user part) is reported if its text
holds an access identifier within the same scope, which is `SCOPE` code
points; an endpoint also if a reported assignment is that near.

Everything is SQL: each pattern splits a text into gaps and matches, whose
lengths sum up to spans (running sums by blocks, so a text with very many
spans takes time in proportion). Parts are joined on document, text and scope
block, so a document with very many parts meets only those near by, and a
block has room for a bounded number of them.

Bounds in the patterns: an endpoint's scheme has 2 to 16 characters, its host
labels 63 at most (as in DNS), of which a host with a port has 2 to 16; of a
longer name the first 16 labels that a port follows are the match.

Defined results: null text counts as empty and has no span; repeated rows
each return their row; rows without doc_id are told apart by their text. An
empty table gives none. Extra columns of any name are not read by `find`;
`redact` returns them as they are, but for n_chars.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beatlake.llm.common import boxed, let, require
from beatlake.scratch import Scratch

SCOPE = 400

# The patterns. Each also runs in RE2, so classes name both cases.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BODY = r"[A-Za-z0-9+/]{40,}={0,2}"
ENDPOINT = r"(?:[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D/@\"'<>]+@[A-Za-z0-9.-]+|[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,15}:[0-9]{2,5})"
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "body": BODY, "endpoint": ENDPOINT}
#: The order of kinds in listings.
KINDS = tuple(PATTERNS)
MASK = "[REDACTED]"

SPANS = "array<struct<start:bigint,kind:int,end:bigint,link:boolean>>"
#: Elements of an array that one running fold copies; code points of a piece of text.
RUN, PIECE = 256, 4096


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What `step` makes of all elements before each one, from 0 (bigint).

    Folds within blocks of `RUN` from what the blocks before give, since a fold copies its array at each element.
    """
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<bigint>")

    def fold(block: Column, start: Column) -> Column:
        begin = F.struct(start.alias("now"), none.alias("out"))
        return F.aggregate(block, begin, lambda acc, x: F.struct(step(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")), lambda acc: acc["out"])

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda i: F.slice(v, i * RUN + 1, RUN))

    def scan(parts: Column) -> Column:
        starts = fold(F.transform(parts, lambda b: F.aggregate(b, zero, step)), zero)
        return F.flatten(F.zip_with(parts, starts, fold))

    return let(values, lambda v: F.when(F.size(v) == 0, none).otherwise(let(blocks(v), scan)))


def spans_of(kind: str, text: Column) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end, link) in code points; link: needs a partner."""
    pattern, number = PATTERNS[kind], KINDS.index(kind)
    none = F.array().cast(SPANS)
    length = lambda x: F.length(x).cast("bigint")

    def spans(gaps: Column, found: Column) -> Column:
        # gap i stands before match i; the last gap has no match
        steps = F.transform(found, lambda m, i: length(gaps[i]) + length(m))
        at = F.zip_with(running(steps, lambda a, b: a + b), found, lambda a, m: F.struct(a.alias("a"), m.alias("m")))
        made = F.transform(at, lambda x, i: F.struct((x["a"] + length(gaps[i])).alias("start"), F.lit(number).alias("kind"), (x["a"] + length(gaps[i]) + length(x["m"])).alias("end"), F.lit(kind in ("body", "endpoint")).alias("link"), good(kind, x["m"]).alias("ok")))
        return F.transform(F.filter(made, lambda s: s["ok"]), lambda s: F.struct(*(s[c].alias(c) for c in ("start", "kind", "end", "link"))))

    walk = let(F.split(text, pattern, -1), lambda gaps: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: spans(gaps, found)))
    return F.when(text.rlike(pattern), walk).otherwise(none).cast(SPANS)


def good(kind: str, match: Column) -> Column:
    """Whether a match counts, by what it holds."""
    if kind == "assign":
        # what follows the first : or =
        return F.length(F.regexp_extract(match, r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", 1)) >= 6
    if kind == "body":
        return match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("[0-9]")
    return F.lit(True)


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, text key and all spans, base and weak, of each row."""
    require(docs, "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_key"), F.concat(*(spans_of(k, text) for k in KINDS)).alias("parts"))


def linked(found: DataFrame) -> DataFrame:
    """doc_id, text_key and the weak spans of it that have a complementary part in their scope.

    An interval join on the blocks of `SCOPE` code points. A weak part is in
    every block that its span covers, a partner in every block that its span
    covers when widened by `SCOPE` on both sides; so two parts in scope of one
    another share a block, however long they are and wherever they start.
    """
    rows = found.where(F.exists("parts", lambda p: p["link"])).dropDuplicates(["doc_id", "text_key"])
    part = rows.select("doc_id", "text_key", F.explode("parts").alias("p"))
    number = KINDS.index
    block = lambda at: F.floor(at / SCOPE)
    weak = part.where("p.link").select("doc_id", "text_key", F.col("p").alias("w"), F.explode(F.sequence(block(F.col("p.start")), block(F.col("p.end")))).alias("block"))
    strong = part.where(F.col("p.kind").isin(number("access"), number("assign"))).select(
        "doc_id", "text_key", F.col("p").alias("s"), F.explode(F.sequence(block(F.col("p.start") - SCOPE), block(F.col("p.end") + SCOPE))).alias("block")
    )
    a, b = weak.alias("a"), strong.alias("b")
    on = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key")) & (F.col("a.block") == F.col("b.block"))
    near = (F.col("s.start") - F.col("w.end") <= SCOPE) & (F.col("w.start") - F.col("s.end") <= SCOPE)
    fits = (F.col("s.kind") == number("access")) | (F.col("w.kind") == number("endpoint"))
    return a.join(b, on & near & fits, "left_semi").groupBy("doc_id", "text_key").agg(F.collect_set("w").alias("extra"))


def find(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text_key and `spans` (start, kind, end, link) of every row, ordered by start, then kind."""
    scratch = Scratch(spark, "secrets")
    found = scratch.save(parts(docs))
    extra = linked(found)
    a, b = found.alias("a"), extra.alias("b")
    on = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key"))
    spans = F.array_sort(F.concat(F.filter("parts", lambda p: ~p["link"]), F.coalesce("extra", F.array().cast(SPANS))))
    return a.join(b, on, "left").select("a.doc_id", "a.text_key", spans.alias("spans"))


def listing(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def masked(text: Column, spans: Column, mask: str) -> Column:
    """`text` with spans (sorted by start) replaced by `mask`; spans that overlap share one.

    What is kept between them is cut from pieces of `PIECE` code points, so no cut counts from the start of a long text.
    """

    def cut(pieces: Column, a: Column, z: Column) -> Column:
        """Code points a to z (exclusive)."""
        first, last = F.floor(a / PIECE).cast("int"), F.floor((z - 1) / PIECE).cast("int")
        part = lambda i, x, y: pieces[i].substr((x + 1).cast("int"), (y - x).cast("int"))
        near = part(first, a - first * PIECE, z - first * PIECE)
        far = F.concat(part(first, a - first * PIECE, F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), part(last, F.lit(0), z - last * PIECE))
        return F.when(z <= a, "").when(first == last, near).otherwise(far)

    def build(pieces: Column) -> Column:
        reach = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        new = F.filter(F.zip_with(spans, reach, lambda s, r: F.struct(r.alias("r"), s["start"].alias("a"))), lambda x: (x["a"] >= x["r"]))
        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        kept = F.transform(new, lambda x: F.concat(cut(pieces, x["r"], x["a"]), F.lit(mask)))
        return F.concat(F.array_join(kept, ""), cut(pieces, end, F.length(text).cast("bigint")))

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), build)


def redact(spark: SparkSession, docs: DataFrame, mask: str = MASK) -> DataFrame:
    """`docs` with every found span replaced by `mask`, overlapping ones by one; n_chars, if there, counts anew."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    hits = find(spark, docs).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"]).withColumnRenamed("doc_id", "hit_id")
    rows = boxed(docs, F.col("doc_id").alias("own_id"), key.alias("own_key")).join(hits, F.col("own_id").eqNullSafe(F.col("hit_id")) & (F.col("own_key") == F.col("text_key")), "left")
    text = F.col("row.text")
    clean = rows.select("row", F.col("spans").isNotNull().alias("hit"), F.when(F.col("spans").isNull(), text).otherwise(masked(text, F.col("spans"), mask)).alias("clean"))
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("hit"), F.length("clean")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return clean.select(*(v.alias(c) for c, v in out.items()))

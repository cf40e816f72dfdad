"""op11 to op13: each against a brute-force version, and on nulls, long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatlake.llm import lexical, queries, repair, suffix_dedup

WORDS = "alpha beta gamma delta Épsilon zeta eta Theta iota kappa x1 42".split()


# Ranked lexical search


def plain_search(docs, items, top=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    fold = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    split = lambda t: [x.translate(fold) for x in term.findall(t or "")]
    counts = [(d, Counter(split(t))) for d, t in docs]
    n_docs, length = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counts:
            n = sum(c.values())
            m = 25 + (75 * n * n_docs) // length if n else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in split(text) if t in c)
            if s > 0:
                scores.append((-s, d is None, d if d is not None else 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def corpus(rng, n):
    return [(i, " ".join(rng.choice(WORDS, rng.integers(0, 12), p=np.arange(1, 13) / 78)) + rng.choice([".", "", "!?"])) for i in range(n)]


@pytest.mark.parametrize("blocks", [1, 4])
def test_search_like_brute_force(spark, monkeypatch, blocks):
    rng = np.random.default_rng(1)
    docs = corpus(rng, 300) + [(7, "alpha alpha"), (7, "alpha alpha"), (None, "alpha beta"), (None, "alpha beta"), (900, None), (901, ""), (902, "alpha " * 5000)]
    items = [(i, t) for i, t in corpus(rng, 12)] + [(3, "alpha"), (3, "alpha"), (50, None), (51, "nowhere"), (None, "42 42 ÉPSILON Épsilon")]
    monkeypatch.setattr(lexical, "ITEMS", len(items) if blocks == 1 else 4)
    monkeypatch.setattr(lexical, "FEW", 40)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("n", "terms", "tfs", "shard", "block")})
    q = spark.createDataFrame(items, "item_id bigint, text string").withColumns({c: F.lit(1) for c in ("item", "term", "w", "rank")})
    got = sorted((tuple(r) for r in lexical.search(spark, d, q).collect()), key=repr)
    assert got == plain_search(docs, items)


def test_pivots_skip_and_lose_nothing(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lexical, "WINDOW", 16)
    rng = np.random.default_rng(2)
    n = 600
    words = [f"w{i}".encode() for i in range(30)]
    rows = [[w for w in words[: 1 + i % 30] if rng.random() < 0.5] for i in range(n)]
    tfs = [[int(rng.integers(1, 5)) for _ in r] for r in rows]
    table = pa.table({"doc_id": pa.array(rng.permutation(n)), "n": pa.array([sum(t) for t in tfs]), "terms": pa.array(rows, pa.list_(pa.binary())), "tfs": pa.array(tfs, pa.list_(pa.int64()))})
    shard = lexical.Shard(table, n, sum(map(sum, tfs)))
    length = sum(map(sum, tfs))
    asked = [(w, int(x)) for w, x in zip(words, rng.integers(0, 3000, 30))]
    scores = {}
    for d, r, t in zip(table["doc_id"].to_pylist(), rows, tfs):
        m = 25 + (75 * sum(t) * n) // length
        scores[d] = sum(dict(asked)[w] * ((10**9 * f) // (1000 * f + 8 * m)) for w, f in zip(r, t))
    want = sorted(((-s, d) for d, s in scores.items() if s > 0))[:10]
    at, best = shard.search(asked)
    assert [(-s, d) for s, d in zip(best.tolist(), shard.ids.take(pa.array(at)).to_pylist())] == want


def test_long_texts_are_counted_whole(monkeypatch):
    text = b"Abc-def " * 1000 + "Ünïcode".encode()
    whole = lexical.count_terms(text)
    monkeypatch.setattr(lexical, "CHUNK", 7)
    assert lexical.count_terms(text) == whole and whole[0] == 2001 and whole[1]["Ünïcode".encode()] == 1
    assert lexical.count_terms(None) == (0, Counter())


def test_search_in_empty_tables(spark):
    d, q = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    full = spark.createDataFrame([(1, "alpha")], "doc_id bigint, text string")
    assert lexical.search(spark, d, q).collect() == []
    assert lexical.search(spark, full, q).collect() == []
    assert lexical.search(spark, d, full.withColumnRenamed("doc_id", "item_id")).collect() == []


# Repeated strings


def plain_removal(texts, n):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("threshold", [1, 8, 24])
def test_repeats_like_brute_force(spark, threshold):
    rng = np.random.default_rng(threshold)
    letters = lambda k, a="abcé": "".join(rng.choice(list(a), k))
    passages = [letters(int(k), "abcdefgh") for k in rng.integers(threshold, 3 * threshold + 2, 8)]
    texts = [letters(int(rng.integers(0, 60)), "abcdefghijkl") + passages[rng.integers(8)] + letters(int(rng.integers(0, 60)), "mnopqrst") for _ in range(60)]
    texts += [letters(200, "ab"), "z" * 300, "zz", "", None, None, texts[0], texts[0][:-1] + "!", texts[1] + "é", "🙂" * threshold]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id int, text string, text_key string, copies int").withColumns({c: F.lit(0) for c in ("spans", "lo", "hi", "rank", "n_bytes")})
    r = suffix_dedup.Repeats(spark, docs, threshold)
    got = suffix_dedup.of_documents(docs, suffix_dedup.digests(r.removed()), ("n_bytes", "n_removed", "n_spans", "kept_sha256")).orderBy("doc_id")
    assert [(x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got.collect()] == plain_removal(texts, threshold)
    assert {"text_key", "copies", "lo"} <= set(got.columns)


def test_remove_keeps_columns_and_gives_what_is_left(spark):
    docs = spark.createDataFrame([(1, "abcdefgh123", "k"), (2, "xabcdefghy", "k"), (None, None, None)], "doc_id int, text string, kept string")
    got = {r.doc_id: (bytes(r.kept), [tuple(s) for s in r.spans]) for r in suffix_dedup.remove(spark, docs, 8).collect()}
    assert got == {1: (b"123", [(0, 8)]), 2: (b"xy", [(1, 9)]), None: (b"", [])}
    assert suffix_dedup.remove(spark, docs.limit(0), 8).count() == 0


def test_positions_cover_every_start_once(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    for piece in (64, 1000, 1 << 15):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        for length, before in ((50, 25), (100, 50), (175, 100), (200, 197)):
            spans = [(0, 1200), (1300, 1300), (2000, 4800)]
            covered = [s for *_, run, _, lo in suffix_dedup.positions(data, spans, length, before, 200) for a, n in zip(lo, run) for s in range(a, a + n)]
            assert covered == [s for a, b in spans for s in range(a, b + 1)]


def test_lengths_at_most_double():
    for n in (1, 2, 8, 50, 400, 1000):
        steps = suffix_dedup.lengths(n)
        assert steps[-1] == n and all(a < b <= 2 * a for a, b in itertools.pairwise(steps))


def test_repeats_over_all_documents_of_a_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op12_suffix_dedup(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == {(r.doc_id, *d) for r, d in zip(rows, plain_removal([r.text for r in rows], 400))}


# Conversation repair


def plain_repair(rows):
    """The least (cost, audit) over all sequences of edits, with the repaired rows, by search over strings."""
    best = {0: (0, "", ())}
    insert = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}

    def spread(states):
        todo = list(states.items())
        while todo:
            state, (cost, audit, out) = todo.pop()
            to, role = insert[state]
            new = (cost + 3, audit + "I", (*out, f"{role}:"))
            if cost < 40 and (to not in states or new < states[to]):
                states[to] = new
                todo.append((to, new))
        return states

    seen = set()
    for role, text in rows:
        words = text.strip(" \t\n\v\f\r")
        gone = not words or (role, text) in seen
        late = 3 * (not gone and words[-1] not in ".!?")
        seen.add((role, text))
        new = {}

        def offer(state, value):
            if state not in new or value < new[state]:
                new[state] = value

        for state, (cost, audit, out) in paths(best):
            offer(state, (cost + 4, audit + "D", out))
            if not gone:
                to, other = insert[state]
                offer(to, (cost + 3 + late, audit + "R", (*out, f"{other}:{text}")))
                kept = {"s": 1 if state == 0 else None, "u": 2 if state != 2 else None, "a": 3 if state == 2 else None}.get(role[:1])
                if kept:
                    offer(kept, (cost + late, audit + "K", (*out, f"{role}:{text}")))
        best = new
    return min(v for s, v in paths(best) if s in (0, 3))


def paths(states):
    """Every state with each way to it by up to three inserts."""
    insert = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
    for state, (cost, audit, out) in states.items():
        for n in range(4):
            yield state, (cost + 3 * n, audit + "I" * n, out)
            state, role = insert[state]
            out = (*out, f"{role}:")


def wanted(rows):
    rows = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, counts = set(), Counter()
    for _, role, text in rows:
        words = text.strip(" \t\n\v\f\r")
        counts["blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "fine"] += 1
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, out = plain_repair([r[1:] for r in rows])
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def talks(rng, n, longest):
    texts = ["Hi.", "Yes!", "no end", "", " \t", "So?", "Ünï.", "Well."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", ""]
    rows = []
    for conv in range(n):
        for turn in range(int(rng.integers(1, longest))):
            if rng.random() < 0.9:
                rows.append((conv, None if rng.random() < 0.03 else turn + int(rng.random() < 0.1), None if rng.random() < 0.03 else str(rng.choice(roles)), None if rng.random() < 0.03 else str(rng.choice(texts))))
    return rows


@pytest.mark.parametrize("rows_a_block", [256, 2])
def test_repair_like_brute_force(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(repair, "ROWS", rows_a_block)
    rows = talks(np.random.default_rng(rows_a_block), 120, 10) + [(None, 1, "user", "Hi."), (None, 2, "user", "Yes."), (500, None, None, None)]
    by = defaultdict(list)
    for conv, *row in rows:
        by[conv].append(row)
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit("x") for c in ("block", "turns", "cost", "audit")})
    done = repair.Repair(spark, turns)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in done.conversations().collect()}
    assert got == {conv: wanted(r) for conv, r in by.items()}
    lines = defaultdict(list)
    for r in done.turns().orderBy("conv_id", "block", "place").collect():
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for conv, r in got.items():
        roles = "".join(x[:1] for x in lines[conv])
        assert re.fullmatch(r"(s?(ua)+)?", roles) and hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == r[-1]


def test_a_long_conversation_in_many_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(1, i, str(rng.choice(["user", "assistant"])), f"Turn {i}{rng.choice(['.', ''])}" if i % 9 else "Again.") for i in range(3000)] + [(2, 0, "user", "w" * 5_000_000 + ".")]
    got = {r.conv_id: r for r in repair.Repair(spark, spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).conversations().collect()}
    r = got[1]
    assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == wanted([x[1:] for x in rows[:3000]])
    assert (got[2].audit, got[2].cost) == ("KI", 3)


def test_codes_are_prefix_free_and_ordered():
    assert list(repair.CODES) == sorted(repair.CODES) and not any(a != b and b.startswith(a) for a in repair.CODES for b in repair.CODES)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    done = repair.Repair(spark, empty)
    assert done.conversations().collect() == [] and done.turns().collect() == []


def test_every_conversation_is_returned(spark):
    sf = "/root/testdata/sf0.001"
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    got = queries.op11_conversation_repair(spark, sf).collect()
    assert sorted(r.conv_id for r in got) == sorted(r.conv_id for r in turns.select("conv_id").distinct().collect())
    by = defaultdict(list)
    for r in queries.damaged(turns).collect():
        by[r.conv_id].append((r.turn, r.role, r.text))
    for r in got:
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == (wanted(by[r.conv_id]) if by[r.conv_id] else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))

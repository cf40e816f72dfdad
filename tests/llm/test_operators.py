"""The corpus operators on small tables with nulls, empty and long texts, ties, repeated rows, no rows and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from beatlake.llm import ann, chat, langid, mixing, outliers, packing, secrets, simhash, site_quality, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside.
CLASH = ("rate", "copies", "fp", "spans", "_b", "key", "mask", "_key", "copy_no", "parts", "x", "g", "host", "path", "toxic", "u", "node", "is_toxic", "p_toxic", "mix_key", "row", "ident", "text_key", "id", "no_id", "root", "held", "raw", "distance", "label", "good", "n", "m", "w")
rng = np.random.default_rng(7)
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"] + [f"w{i}" for i in range(300)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


TEXTS = [prose(60, i) for i in range(30)]
ROWS = (
    [(i, t, ("en", "de")[i % 2], f"src{i % 3}", len(t)) for i, t in enumerate(TEXTS)]
    + [(100, TEXTS[0], "en", "src0", 1), (101, TEXTS[0] + ".", "en", None, 1), (100, TEXTS[0], "en", "src0", 1)]  # copies, a repeated row
    + [(200, None, None, None, None), (201, "", "", "", 0), (202, "   \n\t ", "en", "src1", 5), (None, "no id at all", "en", "src1", 5), (203, prose(20_000, 99), "en", "src0", 0), (204, "Ünïcode ÄÖ 語 🎉 é", "de", "src1", 9)]
)


def frame(spark, rows=ROWS, clash=False):
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("clash") for c in CLASH}) if clash else df


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


EMBED = "vec_id bigint, embedding array<float>"


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert mixing.mix(empty).count() == 0
    assert toxicity.score(empty, toxicity.fit(spark, empty, labels(spark)), ["doc_id"]).count() == 0
    assert simhash.near_duplicates(spark, empty).count() == 0 and simhash.keep_first(spark, empty).count() == 0
    assert langid.identify(empty, langid.fit(spark, empty)).count() == 0
    assert packing.pack(empty, tokenizer()).count() == 0
    assert site_quality.classify(spark, empty, labels(spark), F.col("source"), F.col("lang")).count() == 0
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))).count() == 0
    assert outliers.verdicts(spark, outliers.statistics(empty)).count() == 0
    assert secrets.find(spark, empty).count() == 0 and secrets.redact(spark, empty).count() == 0
    assert ann.nearest(spark, spark.createDataFrame([], EMBED), F.col("vec_id") >= 0).count() == 0


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- mixing


def poisson(u, rate):
    k, p, c = 0, np.exp(-rate), np.exp(-rate)
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


@pytest.mark.parametrize("clash", [False, True])
def test_mix_like_brute_force(spark, clash):
    df = frame(spark, clash=clash)
    w, other = {"src0": 0.5, "src1": 0.25}, 0.25
    out = mixing.mix(df, w, other, 1.5, "s")
    got = out.select("doc_id", "text", "copy_no").collect()
    assert len(set(out.columns)) == len(out.columns) == len(set(df.columns) | set(mixing.OWN))
    same = mixing.repeat(df, w, other, 1.5, "s")
    assert same.columns == df.columns and same.count() == len(got) and (not clash or {r["copies"] for r in same.collect()} == {"clash"})
    mass = {}
    for r in ROWS:
        k = r[3] if r[3] in w else None
        mass[k] = mass.get(k, 0) + len(r[1] or "")
    want = []
    for r in ROWS:
        k = r[3] if r[3] in w else None
        rate = w.get(k, other) / 1.0 * 1.5 * sum(mass.values()) / mass[k]
        u = int(hashlib.md5(f"s:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:12], 16) / 16**12
        want += [(r[0], r[1], i) for i in range(poisson(u, rate))]
    key = lambda x: (x[0] is None, x[0] or 0, str(x[1]), x[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_tiny_sources_reach_their_weight(spark):
    rows = [(i, "x" * 4000, "en", "big", 1) for i in range(100)] + [(1000 + i, "y" * 10, "en", "tiny", 1) for i in range(4)]
    got = mixing.mix(frame(spark, rows), {"tiny": 0.25, "big": 0.75}, 0.0, 1.0, "s")
    mass = {r["source"]: r["m"] for r in got.groupBy("source").agg(F.sum(F.length("text")).alias("m")).collect()}
    assert abs(mass["tiny"] / (100 * 4000 + 40) - 0.25) < 0.02  # a rate of 2,500
    assert got.where("source = 'tiny'").select("doc_id", "copy_no").distinct().count() == mass["tiny"] / 10


def test_sql_of_mixing_at_a_large_rate(spark, tmp_path, monkeypatch):
    import duckdb

    from beatlake.llm import oracle, queries

    rows = [(i, "x" * 4000, "en", "big", 1) for i in range(60)] + [(1000, "y" * 11, "en", "src3", 1)]
    frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_mix_sources(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(oracle.op1())
    assert got.where("source = 'src3'").first()["rate"] > 1000
    assert sorted(map(str, map(tuple, got.select(*sorted(got.columns)).collect()))) == sorted(map(str, want.select(", ".join(sorted(want.columns))).fetchall()))


# --- toxicity


def toxic_rows():
    """Two languages whose toxic documents share no word; every fifth document is toxic."""
    marks = (("idiot", "moron", "trash", "scum"), ("xachlichen", "xachlichung", "xachlichst", "xachlicher"))
    rows, lab = [], []
    for i in range(400):
        t = prose(40, 1000 + i)
        toxic = i % 5 == 0
        mine = marks[i // 5 % 2]
        rows.append((i, t + (f" {mine[i // 10 % 4]} {mine[(i // 10 + 1) % 4]}" if toxic else ""), ("en", "de")[i // 5 % 2], "s", 1))
        if i < 300:
            lab.append((i, 1, int(toxic)))
    return rows, lab


def test_toxicity_learns_words_and_prefixes(spark):
    rows, lab = toxic_rows()
    docs = frame(spark, [*rows, rows[3], *ROWS[33:]], clash=True)
    chain = toxicity.fit(spark, docs, labels(spark, [*lab, (0, 1, None), (None, 1, 1), (1, 1, 0)]))
    scored = toxicity.score(docs, chain, ["doc_id", "p_toxic", "is_toxic", "text"])
    got = {r["doc_id"]: r for r in scored.collect()}
    assert all(got[i]["is_toxic"] == (i % 5 == 0) for i in range(400) if not 200 <= i < 205)
    assert not got[201]["is_toxic"] and chain.categories == ("group1", "group2", "toxic")
    # each kind is one of the languages
    groups = [{i // 5 % 2 for i in range(0, 400, 5) if got[i][f"p_group{g}"] > 0.5 and not 200 <= i < 205} for g in (1, 2)]
    assert sorted(map(sorted, groups)) == [[0], [1]]
    left = toxicity.drop_toxic(docs, chain)
    assert left.columns == docs.columns and left.count() == docs.count() - 80
    p = toxicity.score(frame(spark, [(1, "nothing here", None, None, None)]), chain, ["doc_id"]).first()
    assert 0 < p["p_toxic"] < 0.5


def test_labelled_categories_string_ids_and_repeated_ids(spark):
    rows, lab = toxic_rows()
    docs = spark.createDataFrame([(f"d{r[0]}", r[1]) for r in rows for _ in range(2)], "doc_id string, text string")
    known = spark.createDataFrame([(f"d{i}", int(t and i // 5 % 2 == 0), t) for i, _, t in lab], "doc_id string, insult int, toxic int")
    chain = toxicity.fit(spark, docs, known, ("insult",), max_train=300)
    assert toxicity.training_sample(docs, known, ("insult", "toxic"), 250).count() == 250
    got = {r["doc_id"]: r for r in toxicity.score(docs, chain, ["doc_id"]).collect()}
    assert chain.categories == ("insult", "toxic")
    assert all((got[f"d{i}"]["p_insult"] > 0.5) == (i % 5 == 0 and i // 5 % 2 == 0) and got[f"d{i}"]["is_toxic"] == (i % 5 == 0) for i in range(300))


def test_features_like_a_plain_count(spark):
    rows, lab = toxic_rows()
    chain = toxicity.fit(spark, frame(spark, rows), labels(spark, lab))
    seen = [(toxicity.features(rows[i][1]), y) for i, _, y in lab]
    n, p = len(seen), sum(y for _, y in seen)
    gains = {}
    for w in set().union(*(f for f, _ in seen)):
        d, k = sum(w in f for f, _ in seen), sum(y for f, y in seen if w in f)
        if d > 1 and k > d * p / n:
            gains[w] = k * np.log(k / (d * p / n)) + ((d - k) * np.log((d - k) / (d * (1 - p / n))) if d > k else 0)
    assert set(chain.index) == {w for w, g in gains.items() if g >= toxicity.MIN_GAIN} and len(chain.index) >= 10
    # the chain's formula, on dense inputs
    for i, _, _ in lab[:60]:
        x, odds = np.array([f in toxicity.features(rows[i][1]) for f in chain.index], float), []
        for w, b in zip(chain.weights, chain.bias):
            odds.append(float(np.clip(w @ np.array([*x, *odds]) + b, -12, 12)))
        assert np.allclose(chain.probabilities(rows[i][1]), 1 / (1 + np.exp(-np.array(odds))))


def test_features_of_frequent_words_like_a_plain_count():
    text = "Xachlichen xachlichst; other words here. Other " + "filler " * 150
    words = text.lower().replace(";", "").replace(".", "").split()
    all_of = [f for w in words for f in (w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) > n))]
    often = {f + "+" for f in all_of if all_of.count(f) > 1 and all_of.count(f) * 100 >= len(words)}
    assert toxicity.features(text) == set(all_of) | often
    assert "xachli*+" in often and "xachlichen+" not in often and "other+" in often
    assert "other+" not in toxicity.features(text + " filler" * 100)
    assert toxicity.features(None) == toxicity.features("") == set()
    # a chain finds the known ones among them
    known = ["xach*", "xachli*+", "other", "other+", "fill*+", "filler", "filler+", "absent", "wordy*", "here+"]
    chain = toxicity.Chain((), {f: i for i, f in enumerate(known)}, (), ())
    for t in (text, text + " filler" * 100, "other Other wordily wordyness", "", None):
        assert chain.hits(t) == sorted(i for f, i in chain.index.items() if f in toxicity.features(t))


def test_a_small_language_is_learned_beside_a_large_one(spark):
    """In the small one a syllable now and then is clean and several are toxic; the large one has many telling words."""
    docs, lab = [], []
    for i in range(1000):
        small = i % 10 == 9
        toxic = i // 10 % 4 == 0
        r = np.random.default_rng(i)
        words = prose(60, 5000 + i).split()
        stems = [f"zumbr{x}" for x in ("a", "il", "or", "une", "est", "ack", "ion", "ul")]
        if small:
            for k in r.choice(60, 5 if toxic else int(r.random() < 0.4), replace=False):
                words[k] = str(r.choice(stems))
        elif toxic:
            words[:3] = [f"vile{chr(97 + x // 26)}{chr(97 + x % 26)}" for x in r.integers(0, 400, 3)]
        docs.append((i, " ".join(words), "xx" if small else "en", "s", 1))
        if i < 600:
            lab.append((i, 1, int(toxic)))
    got = {r["doc_id"]: r["is_toxic"] for r in toxicity.score(frame(spark, docs), toxicity.fit(spark, frame(spark, docs), labels(spark, lab)), ["doc_id"]).collect()}
    held = [i for i in range(600, 1000) if i % 10 == 9]
    assert sum(got[i] == (i // 10 % 4 == 0) for i in held) >= len(held) - 1


def hits(rows):
    return toxicity.Hits(len(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows))


def test_out_of_fold_inputs_of_the_chain():
    rows = [np.array([0]) if i % 2 else np.array([1]) for i in range(80)]
    y = np.array([[i % 2, i % 2] for i in range(80)])
    chain = toxicity.fit_chain(hits(rows), y, np.arange(80) % 4, {"a": 0, "b": 1}, ("first", "second"))
    assert len(chain.weights[1]) == 3 and chain.weights[1][2] > 0  # the earlier category's log-odds count
    assert chain.probabilities("a")[1] > 0.9 > 0.1 > chain.probabilities("b")[1]
    alone = toxicity.fit_chain(hits(rows), y[:, 1:], np.arange(80) % 4, {"a": 0, "b": 1}, ("second",))
    assert abs(alone.probabilities("a")[0] - chain.probabilities("a")[1]) > 1e-4  # without the chain another result


def test_logistic_weights_are_stationary():
    r = np.random.default_rng(0)
    rows = [np.flatnonzero(r.random(12) < 0.3) for _ in range(200)]
    y = np.array([float(0 in x or r.random() < 0.2) for x in rows])
    w, b = toxicity.fit_logistic(hits(rows), np.zeros((200, 0)), y, 12, steps=5000)
    x = np.array([[k in row for k in range(12)] for row in rows], float)
    g = 1 / (1 + np.exp(-(x @ w + b))) - y
    assert np.abs(x.T @ g + 0.02 * w).max() < 0.02


# --- near-duplicates


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def roots(ids, values, radius):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and bin(values[i] ^ values[j]).count("1") <= radius:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_like_brute_force(spark):
    got = simhash.near_duplicates(spark, frame(spark, clash=True)).collect()
    assert len(got) == len(ROWS)
    fps = {r[0]: brute_simhash(r[1]) for r in ROWS if r[0] is not None}
    want = roots(list(fps), fps, 3)
    for r in got:
        if r["doc_id"] is not None:
            assert r["fp"] % (1 << 64) == fps[r["doc_id"]] and r["component_id"] == want[r["doc_id"]]
    kept = simhash.keep_first(spark, frame(spark, clash=True)).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(set(want.values())) and len(kept) == len(set(want.values())) + 1


def test_one_row_stays_of_each_component(spark):
    a, b, c = prose(60, 1), prose(60, 2), prose(60, 3)
    rows = [(5, a), (5, b), (3, b), (5, a), (None, c), (None, c + ""), (None, a), (7, None), (8, "")]
    kept = simhash.keep_first(spark, frame(spark, [(i, t, "en", "s", 1) for i, t in rows])).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted([("5", a), ("3", b), ("None", c), ("7", None)])


@pytest.mark.parametrize("bucket", [4, 1024])
def test_covering_loses_no_link(spark, bucket):
    from beatlake.scratch import Scratch

    r = np.random.default_rng(3)
    base = [int(r.integers(0, 1 << 63)) for _ in range(40)]
    values = set(base)
    for b in base[:10]:
        for _ in range(25):  # a chain and a clump around each
            b ^= sum(1 << int(i) for i in r.choice(64, r.integers(1, 5), replace=False))
            values.add(b)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    scratch = Scratch(spark, "t")
    nodes = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    found = simhash.components(simhash.candidate_links(nodes, scratch, 3, bucket), scratch)
    got = {v: v for v in signed} | {x["node"]: x["root"] for x in found.collect()}
    want = roots(signed, {v: v % (1 << 64) for v in signed}, 3)
    group = lambda m: sorted(sorted(k for k in m if m[k] == root) for root in set(m.values()))
    assert group(got) == group(want)


def test_masks_cover_all_triples():
    ms = [m % (1 << 64) for m in simhash.masks(list(range(64)), 3, 0)]
    r = np.random.default_rng(0)
    for _ in range(3000):
        diff = sum(1 << int(i) for i in r.choice(64, 3, replace=False))
        assert any(not m & diff for m in ms)


# --- language


def test_languages_in_two_steps(spark):
    letters = {"en": "thewas", "de": "schzei", "fr": "eauxou", "es": "ciónel", "xx": "qqkkjj"}
    rows = []
    for i in range(250):
        lang = list(letters)[i % 5]
        r = np.random.default_rng(i)
        rows.append((i, " ".join("".join(r.choice(list(letters[lang]), 6)) for _ in range(30)), lang, "s", 1))
    docs = frame(spark, [*rows, *ROWS[33:36], (900, "123 456 !?", "en", "s", 1)])
    model = langid.fit(spark, docs)
    assert set(model.families) == {"germanic", "romance", "only xx"} and ("de", "en") in model.machines
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in rows if got[r[0]]["held_out"]]) > 0.95
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(250))
    assert [got[i]["lang_pred"] for i in (200, 201, 202, 900)][3] == "und" and got[900]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_many_languages_are_all_learned(spark):
    # 250 languages, each with letters of its own
    rows = [(i, " ".join([chr(0x4E00 + 3 * (i % 250)) * 2 + chr(0x4E01 + 3 * (i % 250))] * 12), f"l{i % 250}", "s", 1) for i in range(1500)]
    docs = frame(spark, rows, clash=True)
    model = langid.fit(spark, docs, per_lang=6)
    assert len(model.families) == 250
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert np.mean([got[r[0]] == r[2] for r in rows]) > 0.97


def test_machine_like_a_dense_one():
    r = np.random.default_rng(1)
    at = [np.sort(r.choice(200, 20, replace=False)) for _ in range(150)]
    y = np.where([a[0] % 2 for a in at], 1.0, -1.0)
    x = [np.full(20, 20**-0.5) for _ in at]
    w, b = langid.train_machine(at, x, y, passes=200)
    dense = np.zeros((150, 1 << langid.BITS))
    for i, a in enumerate(at):
        dense[i, a] = x[i]
    # the primal value is that of the best of many small steps away from it
    bound = 10.0 * 150 / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    value = lambda w, b: 0.5 * (w @ w + (b / 0.3) ** 2) + (bound * np.maximum(0, 1 - y * (dense @ w + b))).sum()
    best = value(w, b)
    assert all(value(w + d, b) >= best - 0.02 * best for d in (r.normal(size=w.shape) * s for s in (1e-3, 1e-2, 1e-1)))


def test_null_text_is_undefined(spark):
    model = langid.Model({"germanic": ("en",)}, {})
    got = langid.identify(frame(spark, ROWS[33:]), model).collect()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (200, 201, 202)} == {"und"} and {r["lang_pred"] for r in got if r["doc_id"] == 203} == {"en"}


# --- packing


def test_packing_covers_every_token_once(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    got = packing.pack(frame(spark).repartition(2), tokenizer()).collect()
    assert len({(r["doc_id"], r["sequence_id"], r["offset"]) for r in got}) == len(got)
    by_seq, total = {}, {}
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] > 0
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    for pieces in by_seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0 and len(pieces) <= 256
    ids = {r[0]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in ROWS}
    n = {k: sum(r[0] == k for r in ROWS) for k in ids}
    for k, want in ids.items():
        assert total[k] == n[k] * len(want)
        if n[k] == 1:
            parts = sorted((r["start"], r["ids"], r["doc_tokens"]) for r in got if r["doc_id"] == k)
            assert b"".join(p for _, p, _ in parts) == np.array(want, "<u4").tobytes() and {d for _, _, d in parts} == {len(want)}


@pytest.mark.parametrize("text", ["Σας ΟΔΟΣ", "İstanbul ŒÉ", "<|endoftext|>hi", "x\x1cy \x85z", "it's 'RE don'TLL", "日本語 テスト 🎉", "a²½x ªº ŉ", "x\u00ady \u017fK", "e\u0301 A\u030a", " \u3000 b"])
def test_encoder_equals_tokenizer(text):
    e = packing.Encoder(tokenizer())
    assert e([text.encode()])[0] == e.ids(text)


@pytest.mark.parametrize("limits", [(64, 4, 40), (64, 4, 64), (64, 2, 64), (64, 8, 20)])
@pytest.mark.parametrize("masked", [False, True])
def test_limits_hold_and_bins_fill(limits, masked):
    limits = packing.Limits(*limits, window=16)
    packer = packing.Packer(limits)
    r = np.random.default_rng(1)
    sizes = [int(n) for n in r.integers(1, 150, 300)]
    masks = [r.random(n) < 0.5 if masked else None for n in sizes]
    items = [packing.Item(i, np.arange(n, dtype="<u4").tobytes(), n, loss=None if m is None else np.cumsum(m)) for i, (n, m) in enumerate(zip(sizes, masks))]
    seqs = [s for i in items for s in packer.add(i)] + list(packer.finish())
    got = {}
    loss = lambda key, start, n: n - 1 if masks[key] is None else int(masks[key][start : start + n].sum())
    for s in seqs:
        lengths = [len(p[2]) // 4 for p in s]
        assert sum(lengths) <= limits.tokens and len(s) <= limits.segments
        assert sum(loss(p[0], p[1], n) for p, n in zip(s, lengths)) <= limits.loss
        assert [p[5] for p in s] == [0, *np.cumsum(lengths)[:-1]]
        for p in s:
            got.setdefault(p[0], []).append((p[1], p[2]))
    assert all(b"".join(x for _, x in sorted(got[i])) == np.arange(n, dtype="<u4").tobytes() for i, n in enumerate(sizes))
    # no more sequences than the limit that binds asks for, and a few
    least = max(sum(sizes) / limits.tokens, sum(loss(p[0], p[1], len(p[2]) // 4) for s in seqs for p in s) / limits.loss)
    assert len(seqs) <= 1.25 * least + 8


def test_waiting_items_hold_only_what_is_left():
    packer = packing.Packer(packing.Limits(64, 4, 64, 16))
    long = packing.Item(0, np.zeros(64 * 50 + 7, "<u4").tobytes(), 64 * 50 + 7)
    assert len(list(packer.add(long))) == 50 and [len(i.ids) for i in packer.waiting] == [28] and packer.waiting[0].start == 3200


def test_loss_spans_count_and_hold(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    rows = []
    for i in range(60):
        prompt, answer = prose(20 + 37 * i % 150, 6000 + i) + " ", prose(5 + 29 * i % 90, 7000 + i)
        rows.append((i, prompt + answer, [(len(prompt), len(prompt) + len(answer))]))
    df = spark.createDataFrame([*rows, (100, None, []), (101, prose(30, 1), None)], "doc_id bigint, text string, spans array<struct<start:bigint,end:bigint>>").coalesce(1)
    got = packing.pack(df, tokenizer(), packing.Limits(tokens=256, segments=8, loss=64, window=16), loss="spans").collect()
    mask = {}
    for i, text, [(a, z)] in rows:
        mask[i] = [x < z and y > a for x, y in t.encode(text, add_special_tokens=False).offsets] + [True]
    total, bearing, longest = {}, {}, {}
    for r in got:
        k = r["sequence_id"]
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
        longest[k] = longest.get(k, 0) + r["length"]
        here = sum(mask[r["doc_id"]][r["start"] : r["start"] + r["length"]]) if r["doc_id"] in mask else max(0, r["length"] - 1) if r["doc_id"] == 101 else 0
        bearing[k] = bearing.get(k, 0) + here
    assert all(total[i] == len(m) for i, m in mask.items()) and total[100] == 1
    # up to 64 with loss, and longer than that by tokens without
    assert max(bearing.values()) <= 64 and max(longest.values()) > 64 + 1


# --- site quality


def test_sites_like_brute_force(spark):
    junk = lambda i: " ".join(f"{w}###" for w in prose(40, i).split())
    r = np.random.default_rng(5)
    rows = []
    for i in range(300):
        host = f"h{int(r.integers(0, 8))}" if i % 11 else None
        bad = r.random() < (0.7 if host in ("h1", "h2") else 0.1)
        rows.append((i, junk(i) if bad else prose(50, i) + ".", host, f"p{int(r.integers(0, 3))}" if i % 7 else None))
    docs = spark.createDataFrame([*rows, rows[5]], "doc_id bigint, text string, host string, path string")
    lab = {i: int("###" not in rows[i][1]) for i in range(0, 300, 2)}
    got = site_quality.classify(spark, docs, labels(spark, [(i, q, 0) for i, q in lab.items()]), F.col("host"), F.col("path")).collect()
    own = [(g["host"], g["path"], float(lab[g["doc_id"]]) if g["doc_id"] in lab else g["p_text"]) for g in got]

    def totals(key):
        out = {}
        for h, p, v in own:
            n, s = out.get(key(h, p), (0, 0.0))
            out[key(h, p)] = n + 1, s + v
        return out

    hosts, paths = totals(lambda h, p: h), totals(lambda h, p: (h, p))
    n, s = len(own), sum(v for *_, v in own)

    def strength(rows):
        rows = [(k, v / k, m) for k, v, m in rows if k > 1]
        a, e, w = sum((x - m) ** 2 * k for k, x, m in rows), sum(m * (1 - m) for _, _, m in rows), sum(m * (1 - m) * k for k, _, m in rows)
        return 1000.0 if not rows or a <= e else min(1000.0, max(1.0, 1 / max((a - e) / max(w - e, 1e-9), 1e-9) - 1))

    kh = strength([(k, v, s / n) for k, v in hosts.values()])
    around = {h: (v + kh * s / n) / (k + kh) for h, (k, v) in hosts.items()}
    kp = strength([(k, v, around[h]) for (h, p), (k, v) in paths.items() if k < hosts[h][0]])
    logit = lambda p: np.log(p / (1 - p))
    assert len(got) == 301
    for g, (h, p, v) in zip(got, own):
        rest = (s - v) / (n - 1)
        host = (hosts[h][1] - v + kh * rest) / (hosts[h][0] - 1 + kh)
        path = (paths[h, p][1] - v + kp * host) / (paths[h, p][0] - 1 + kp)
        p_text = min(max(g["p_text"], 1e-6), 1 - 1e-6)
        want = 1 / (1 + np.exp(-(logit(p_text) + site_quality.SITE_WEIGHT * (logit(path) - logit(rest)))))
        assert np.allclose([g["host_share"], g["path_share"], g["p_quality"]], [host, path, want], atol=1e-8)
    shares = {g["host"]: g["host_share"] for g in got}
    assert shares["h1"] < shares["h3"] and len({g["host"] for g in got}) == 9


def test_pages_have_hosts_and_paths(spark):
    df = spark.createDataFrame([("https://a.example.com/en/12?x=1", "<p>one <b>two</b></p><script>var t='</p>';</script><!-- no -->three"), ("bad url%%", None), (None, "<")], "url string, html string")
    host, path = site_quality.site_of(F.col("url"))
    got = df.select(host.alias("h"), path.alias("p"), site_quality.visible_text(F.col("html")).alias("t")).collect()
    assert (got[0]["h"], got[0]["p"], got[0]["t"].split()) == ("a.example.com", "en", ["one", "two", "three"]) and got[2]["h"] is None and got[1]["t"] is None


def test_quality_keeps_clean_and_drops_junk(spark):
    junk = lambda i: " ".join(f"{w}###" for w in prose(40, i).split())
    rows = [(i, junk(i) if i % 6 == 0 else prose(50, i) + ".", "en", f"s{i % 4}", 1) for i in range(240)]
    lab = [(i, int(i % 6 != 0), 0) for i in range(150)]
    got = site_quality.classify(spark, frame(spark, [*rows, *ROWS[33:]]), labels(spark, lab), F.col("source"), F.col("lang")).collect()
    assert len(got) == 240 + len(ROWS[33:])
    assert all(r["kept"] == (r["doc_id"] % 6 != 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 200)
    none = site_quality.classify(spark, frame(spark), labels(spark), F.col("source"), F.col("lang"))
    assert none.where("not kept").count() == 0


# --- chat


@pytest.mark.parametrize("text", ["", "plain", "\\### Assistant: </turn> ok", "a\\", "<|image:0|>", "### x:\n</turn>\n", "\\\\<|", "🎉é" * 3])
def test_escape_round_trip(text):
    v = chat.Visitor()
    v.turn("assis:tant\\", [{"type": "text", "text": text}])
    v.turn("assistant", [{"type": "text", "text": text}])
    out = "".join(v.out)
    assert [(r, chat.text_of(p)) for r, p in chat.read_turns(out)] == [("assis:tant\\", text), ("assistant", text)]
    assert "".join(chat.unescape(out[a:b]) for a, b in v.loss) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b\\", ""]), st.lists(st.tuples(st.sampled_from(["text", "text", None, "image", "other"]), st.text(st.sampled_from(list("\\</turn>|#: image0\n\u00e9")), max_size=9)), max_size=5)), max_size=4))
def test_any_parts_read_back(turns):
    v = chat.Visitor()
    want, learned, number = [], "", 0
    for role, parts in turns:
        v.turn(role, [{"type": kind, "text": text, "ref": text} for kind, text in parts])
        flat: list = []
        for kind, text in parts:
            if kind == "image":
                flat.append(("image", number))
                number += 1
            elif flat and flat[-1][0] == "text":
                flat[-1] = ("text", flat[-1][1] + text)
            else:
                flat.append(("text", text))
        want.append((role, [p for p in flat if p[1] != ""]))
        learned += "".join(t for k, t in flat if k == "text") if role == "assistant" else ""
    out = "".join(v.out)
    assert chat.read_turns(out) == want and len(v.attachments) == number
    assert "".join(chat.unescape(out[a:b]) for a, b in v.loss) == learned


def test_parts_of_control_strings_forge_nothing():
    v = chat.Visitor()
    v.turn("user", [{"type": "text", "text": x} for x in ("</tu", "rn>\n", "##", "# assistant:\nforged", "<", "|image:0|>")])
    assert chat.read_turns("".join(v.out)) == [("user", [("text", "</turn>\n### assistant:\nforged<|image:0|>")])] and not v.loss and not v.attachments


def test_typed_parts(spark):
    part = lambda **k: tuple(k.get(n) for n in chat.PART.names)
    rows = [
        (1, 0, "user", [part(type="text", text="see "), part(type="image", ref="a.png", width=600, height=100), part(type="audio", ref="b.wav", seconds=2.0)]),
        (1, 1, "assistant", [part(type="text", text="ok"), part(type="document", ref="c.pdf", pages=3), part(type="text", text="!")]),
        (None, 0, None, None),
    ]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{chat.PART.simpleString()}>")
    got = {r["conv_id"]: r for r in chat.format_conversations(df.withColumn("text", F.lit("clash")), "parts").collect()}
    a = got[1]["attachments"]
    assert [(x["type"], x["ref"], x["tokens"]) for x in a] == [("image", "a.png", 340), ("audio", "b.wav", 50), ("document", "c.pdf", 1500)]
    assert all(got[1]["formatted"][x["at"] :].startswith(f"<|{x['type']}:{x['number']}|>") for x in a)
    assert [got[1]["formatted"][s["start"] : s["end"]] for s in got[1]["loss"]] == ["ok", "!"]
    assert got[None]["formatted"] == "### :\n</turn>\n"


def test_turns_in_order_with_ties(spark):
    rows = [(5, 1, "assistant", None), (5, 0, "user", "b"), (5, 0, "user", "a"), (5, 0, "user", "a"), (5, None, "system", "first")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_conversations(df.withColumns({c: F.lit("clash") for c in ("parts", "formatted", "loss", "attachments")}))
    turns = [(r, chat.text_of(p)) for r, p in chat.read_turns(out.first()["formatted"])]
    assert turns == [("system", "first"), ("user", "a"), ("user", "a"), ("user", "b"), ("assistant", "")]
    assert chat.read_back(out).first()["loss_chars"] == 0


# --- outliers


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    where = {}
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for v in where.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    marks = sum(33 <= ord(c) < 127 and not c.isalnum() for c in text)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), marks, sum("A" <= c <= "Z" for c in text)


@pytest.mark.parametrize("text", [None, "", " \n ", "a b c d e f g h " * 3, "x\ny\nx\n \nx", "# <tag> é語 $%", prose(500, 5) + "\n" + prose(500, 5)])
def test_base_counts(text):
    assert outliers.counts(None if text is None else text.encode()) == brute_counts(text)


def brute_verdicts(rows):
    """Distance of each row (None where the base rules fail) by the same estimates over plain arrays."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    own = F.xxhash64(F.array(*outliers.vector()))
    # only the order of rows within a start's draws comes from this
    hashes = {r["doc_id"]: r["u"] for r in outliers.statistics(frame(spark, rows)).select("doc_id", F.pmod(own, F.lit(1 << 30)).alias("u")).collect()}
    x, key, u = [], [], []
    for r in rows:
        c = brute_counts(r[1])
        n = max(1, c[0])
        sound = c[0] >= 20 and 100 * c[4] <= 30 * c[0]
        x.append([np.log1p(c[0]), c[1] / n, (c[5] / n) ** 0.5, (c[6] / n) ** 0.5])
        key.append((sound, r[2], r[3]))
        u.append(hashes[r[0]])
    x, u = np.array(x), np.array(u)
    sound = np.array([k[0] for k in key])
    ridge = outliers.RIDGE * x[sound].var(0) + 1e-9
    pick = lambda v, q: np.sort(v)[int(np.ceil(q * len(v))) - 1]

    def dist(y, m, c):
        d = y - m
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d)

    def estimate(y, factor):
        return y.mean(0), (y.T @ y / len(y) - np.outer(y.mean(0), y.mean(0))) * factor + np.diag(ridge), len(y)

    def step(y, now):
        part = np.floor(np.log2(np.maximum(dist(y, now[0], now[1]), 1e-12)) * outliers.PARTS)
        return estimate(y[part <= pick(part, outliers.SHARE)], outliers.CONSISTENT)

    def mcd(which, name):
        # of equal rows of a language and source the first counts
        which = np.array(list({(key[i], tuple(x[i])): i for i in reversed(which)}.values()))
        y = x[which]
        order = sorted(range(len(y)), key=lambda i: (u[which][i], tuple(y[i])))
        now, least = outliers.start(y[order], ridge, zlib.crc32(name.encode())), np.inf
        while True:
            new = step(y, now)
            det = np.linalg.slogdet(new[1])[1]
            if det < least:
                now = new
            if not least - det > outliers.STILL:
                break
            least = det
        return estimate(y[dist(y, now[0], now[1]) <= outliers.INNER], outliers.CONSISTENT_INNER)

    def shrink(own, above):
        n, k = own[2], outliers.PRIOR
        return (n * own[0] + k * above[0]) / (n + k), (n * own[1] + k * above[1]) / (n + k)

    def named(*parts):
        return "\x00".join("\x01" if p is None else p for p in parts)

    out = np.full(len(rows), np.nan)
    whole = mcd(np.flatnonzero(sound), "all")
    for lang in {k[1] for k in key if k[0]}:
        of_lang = shrink(mcd(np.array([i for i, k in enumerate(key) if k[0] and k[1] == lang]), named("lang", lang)), whole)
        for source in {k[2] for k in key if k[0] and k[1] == lang}:
            which = np.array([i for i, k in enumerate(key) if k == (True, lang, source)])
            out[which] = dist(x[which], *shrink(mcd(which, named("source", lang, source)), of_lang))
    return out


def varied(n, seed):
    """Prose whose words, marks and capitals vary."""
    r = np.random.default_rng(seed)
    return " ".join((w.capitalize() if r.random() < 0.1 else w) + ("." if r.random() < 0.12 else "") for w in r.choice(WORDS, n))


def test_outliers_like_brute_force(spark):
    rows = [(i, varied(40 + i % 60, i), ("en", "de", None)[i % 3 % (i % 2 + 2)], f"s{i % 4}" if i % 5 else None, 1) for i in range(400)]
    rows += [(1000 + i, " ".join(w + "***" for w in varied(80, i).split()), "en", "s1", 1) for i in range(8)]
    rows += [rows[7]] * 150 + [(2000, varied(50, 1), "xx", "one", 1), (2001, "short", "en", "s1", 1)]
    got = {r["doc_id"]: r for r in outliers.verdicts(spark, outliers.statistics(frame(spark, rows, clash=True))).collect()}
    want = brute_verdicts(rows)
    for r, d in zip(rows, want):
        assert (got[r[0]]["distance"] is None) == np.isnan(d)
        assert np.isnan(d) or abs(got[r[0]]["distance"] - d) <= 1e-6 * max(1.0, d)
        assert got[r[0]]["kept"] == (d <= outliers.CUT)
    assert not any(got[1000 + i]["kept"] for i in range(8)) and np.mean([got[i]["kept"] for i in range(400)]) == 1


def test_verdicts_do_not_depend_on_partitions(spark):
    """A group of more rows than starts are sought on, one document a thousand times, and outliers."""
    rows = [(i, varied(40 + i % 60, i), "en", "s", 1) for i in range(1200)] + [(None, varied(60, i), "en", "s", 1) for i in range(300)]
    rows += [(5000, varied(70, 7), "en", "s", 1)] * 1000 + [(6000 + i, " ".join(w + "***" for w in varied(80, i).split()), "en", "s", 1) for i in range(30)]
    docs = frame(spark, rows)
    one, many = (sorted((str(r["doc_id"]), r["n_punctuation"], r["word_chars"], r["kept"], r["distance"]) for r in outliers.verdicts(spark, outliers.statistics(d)).collect()) for d in (docs.coalesce(1), docs.repartition(64)))
    assert [r[:4] for r in one] == [r[:4] for r in many] and len(one) == len(rows)
    assert np.allclose([r[4] for r in one], [r[4] for r in many], rtol=1e-9)
    assert not [r for r in one if r[0] != "None" and r[3] != (int(r[0]) < 6000)]


def test_start_finds_the_least_determinant():
    """Two fifths of the rows lie apart; no draw of many, gone on with plainly, ends much lower."""
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(0, 1, (240, 4)), r.normal(9, 0.5, (60, 4)), r.normal(-7, 3, (20, 4))])
    ridge = np.full(4, 1e-9)
    m, c = outliers.start(x, ridge, 1)
    least, h = np.inf, 240
    for _ in range(200):
        some = x[r.choice(len(x), 10, replace=False)]
        mm, cc = some.mean(0), np.cov(some.T, bias=True)
        for _ in range(40):
            d = np.einsum("ij,jk,ik->i", x - mm, np.linalg.inv(cc), x - mm)
            y = x[np.argsort(d)[:h]]
            mm, cc = y.mean(0), np.cov(y.T, bias=True)
        least = min(least, np.linalg.slogdet(cc * outliers.CONSISTENT)[1])
    assert np.linalg.slogdet(c)[1] <= least + 0.01 and np.abs(m).max() < 0.5


def test_outliers_of_edge_rows(spark):
    got = outliers.verdicts(spark, outliers.statistics(frame(spark))).collect()
    assert len(got) == len(ROWS) and all(r["kept"] is not None and (r["distance"] is None) == r["base_failed"] for r in got)
    one = outliers.verdicts(spark, outliers.statistics(frame(spark, ROWS[:1]))).first()
    assert one["kept"] and one["distance"] < 1e-6


# --- secrets


def brute_spans(text):
    text = text or ""
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


BODY = "wJalrXUtnFEMI7K7MDENGbPxRfiCYEXAMPLEKEYs"
KEY_ID = "AKIA" + "ABCDEFGHIJKLMNOP"
SECRETS = [
    'é語 password = "hunter22" and token: ab',
    f"🎉 {KEY_ID} then {BODY} at db.example.com:5432 end",
    f"alone {BODY} at db.example.com:5432",
    f"{KEY_ID} " + "x " * 600 + BODY,
    "PassWord:secret1 apiKey='AAAAAA' api_key=short",
    "deadbeef" * 4 + " " + "abc" * 5,
    "secret:token=abcdefgh token=secret: abcdefg",
    None,
    "",
]


def test_secrets_and_links(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(SECRETS)] + [(1, SECRETS[1], "en", "s", 1), (None, SECRETS[0], "en", "s", 1)]
    got = secrets.find(spark, frame(spark, [*rows, *ROWS], clash=True)).collect()
    assert len(got) == len(rows) + len(ROWS)
    texts = dict(enumerate(SECRETS))
    for r in got:
        if r["doc_id"] in texts and r["doc_id"] < len(SECRETS) and r["text_key"] not in ():
            base = [(s["start"], s["kind"], s["end"]) for s in r["spans"] if not s["link"]]
            if base == brute_spans(texts[r["doc_id"]]):
                continue
            assert any(x[0] == r["doc_id"] and base == brute_spans(x[1]) for x in ROWS)
    mine = [[(s["kind"], SECRETS[1][s["start"] : s["end"]]) for s in r["spans"]] for r in got if r["doc_id"] == 1 and len(r["spans"])]
    assert mine == [[(1, KEY_ID), (3, BODY), (4, "db.example.com:5432")]] * 2
    assert all(not any(s["link"] for s in r["spans"]) for r in got if r["doc_id"] in (2, 3))


def test_links_wherever_the_parts_lie_and_however_long_they_are(spark):
    pad = lambda n: "- " * (n // 2)
    long = "aB3/" * 400
    texts = [
        pad(390) + BODY + pad(380) + KEY_ID,  # two blocks apart, a gap of 380
        pad(390) + BODY + " " + pad(398) + " " + KEY_ID,  # a gap of 400
        pad(390) + BODY + " " + pad(400) + KEY_ID,  # a gap of 401
        long + " " + KEY_ID,
        KEY_ID + " " + long,
        "token=" + "x" * 1000 + " db.example.com:5432",
        "db.example.com:5432 token=" + "x" * 1000,
        "token=" + "x" * 1000 + pad(402) + "db.example.com:5432",
    ]
    got = {r["doc_id"]: r for r in secrets.find(spark, frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])).collect()}
    found = [[texts[i][s["start"] : s["end"]] for s in got[i]["spans"] if s["link"]] for i in range(len(texts))]
    end = "db.example.com:5432"
    assert found == [[BODY], [BODY], [], [long], [long], [end], [end], []]


def test_very_many_spans_in_one_text(spark):
    import time

    n = 100_000
    text = " ".join(f"token={i:08d}" for i in range(n))
    df = frame(spark, [(1, text, "en", "s", 1)])
    began = time.time()
    spans = secrets.find(spark, df).first()["spans"]
    assert len(spans) == n and all(text[s["start"] : s["end"]] == f"token={i:08d}" for i, s in enumerate(spans))
    assert secrets.redact(spark, df).first()["text"] == " ".join([secrets.MASK] * n)
    assert time.time() - began < 120


def test_long_user_parts_and_deep_hosts(spark):
    url = "ftp://" + "u" * 3000 + ":pw@host.example.com"
    deep = ".".join(["a"] * 15) + ":8080"
    got = secrets.find(spark, frame(spark, [(1, f"{KEY_ID} {url} {deep} {BODY}", "en", "s", 1)])).first()["spans"]
    text = f"{KEY_ID} {url} {deep} {BODY}"
    # the base rules read a word before a colon, never inside; the last parts are too far from the identifier
    assert [text[s["start"] : s["end"]] for s in got if s["link"]] == [url]


@pytest.mark.parametrize("spans", [[], [(0, 3)], [(2, 5), (4, 9), (9, 12)], [(0, 20_000)], [(1, 4095), (4097, 8192), (8192, 8193), (9000, 15_000)], [(19_999, 20_000)]])
def test_masking_like_slices(spark, spans):
    text = "".join(np.random.default_rng(1).choice(list("abcdé🎉 \n"), 20_000))
    df = spark.createDataFrame([(text, spans)], "text string, spans array<struct<start:bigint,end:bigint>>")
    out, at = "", 0
    for a, z in spans:
        out, at = out + (text[at:a] + "#" if a >= at else ""), max(at, z)
    got = df.select(secrets.masked(F.col("text"), F.col("spans"), "#").alias("t")).first()["t"] if spans else out + text
    assert got == out + text[at:]


def test_redaction(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(SECRETS)] + [(2, "clean text", None, None, None)]
    clashing = frame(spark, rows, clash=True).withColumns({c: F.lit("clash") for c in ("text_key", "_clean", "clean", "row", "hit", "own_key", "own_id", "hit_id")})
    out = secrets.redact(spark, clashing)
    assert out.columns == clashing.columns
    got = out.collect()
    assert all(r["spans"] == r["text_key"] == r["row"] == "clash" for r in got)
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["n_chars"]): r["text"] for r in got}
    text = next(t for (i, _), t in by.items() if i == 1)
    assert text == f"🎉 {secrets.MASK} then {secrets.MASK} at {secrets.MASK} end" and (1, len(text)) in by
    assert by[2, None] == "clean text" and next(t for (i, _), t in by.items() if i == 7) is None


# --- nearest neighbours


def test_nearest_with_copies_and_bad_rows(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(120, 8)).astype(np.float32)
    x[40:80] = x[0]  # a third are copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [None] * 8), (None, x[1].tolist()), (205, []), (3, x[3].tolist())]
    got = ann.nearest(spark, spark.createDataFrame(rows, EMBED).withColumn("score", F.lit("clash")), F.col("vec_id") % 20 == 0).collect()
    d = x.astype(float)
    for q in range(0, 120, 20):
        s = d @ d[q]
        want = sorted((i for i in range(120) if i != q), key=lambda i: (-s[i], i))[:20]
        mine = sorted((v for v in got if v["query_id"] == q), key=lambda v: v["rank"])
        assert [v["vec_id"] for v in mine] == want and [v["rank"] for v in mine] == list(range(1, 21))
        assert np.allclose([v["score"] for v in mine], s[want])


def test_each_dimension_on_its_own(spark):
    rows = [(i, [1.0 + i, 1.0]) for i in range(5)] + [(10 + i, [1.0 + i, 2.0, 3.0]) for i in range(3)] + [(20, [5.0])]
    got = ann.nearest(spark, spark.createDataFrame(rows, EMBED), F.col("vec_id") % 10 == 0).collect()
    assert {q: [v["vec_id"] for v in sorted(got, key=lambda v: v["rank"]) if v["query_id"] == q] for q in (0, 10, 20)} == {0: [4, 3, 2, 1], 10: [12, 11], 20: []}


def check_recall(spark, x, step, least=0.95):
    got = ann.nearest(spark, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], EMBED), F.col("vec_id") % step == 0).collect()
    by = {}
    for v in got:
        by.setdefault(v["query_id"], set()).add(v["vec_id"])
    found = []
    for q in range(0, len(x), step):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        found.append(len(by[q] & set(np.argsort(-s)[:20].tolist())) / min(20, len(x) - 1))
    assert np.mean(found) >= least


def test_few_vectors_run_the_descent_too(spark):
    check_recall(spark, np.random.default_rng(1).normal(size=(50, 8)).astype(np.float32), 5, 1.0)


def test_a_clump_is_cut_and_searched(spark):
    r = np.random.default_rng(4)
    clump = (np.ones(12) + 0.02 * r.normal(size=(5000, 12))).astype(np.float32)
    check_recall(spark, np.concatenate([r.normal(size=(1000, 12)).astype(np.float32), clump]), 200)


def test_long_leaves_are_cut_whole(spark):
    from beatlake.scratch import Scratch

    r = np.random.default_rng(3)
    x = np.concatenate([np.ones((3000, 4)), r.normal(size=(1000, 4))])
    rows = [(i % 2, 7, i, np.asarray(v, np.float16).tobytes()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "tree int, leaf bigint, node bigint, x binary")
    parts = [p.collect() for p in ann.cut_leaves(df, Scratch(spark, "t"))]
    assert sorted(v["node"] for p in parts for v in p) == list(range(4000))
    sizes = {}
    for p in parts:
        for v in p:
            sizes[v["tree"], v["leaf"]] = sizes.get((v["tree"], v["leaf"]), 0) + 1
    assert max(sizes.values()) <= ann.WIDE


def test_fewer_candidates_than_asked(spark):
    got = ann.nearest(spark, spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], EMBED), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(v["vec_id"], v["score"]) for v in got] == [(1, 0.5), (2, 0.0)]
    assert ann.nearest(spark, spark.createDataFrame([(0, [1.0])], EMBED), F.col("vec_id") == 0).count() == 0


def test_recall_of_the_graph(spark):
    r = np.random.default_rng(2)
    x = (r.normal(size=(3000, 16)) + 2 * r.normal(size=(10, 16))[r.integers(0, 10, 3000)]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = ann.nearest(spark, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], EMBED), F.col("vec_id") % 100 == 0).collect()
    hits = 0
    for q in range(0, 3000, 100):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -9
        hits += len({v["vec_id"] for v in got if v["query_id"] == q} & set(np.argsort(-s)[:20].tolist()))
    assert hits / 600 >= 0.9


@pytest.mark.parametrize("size", [1, 2, 3, 5, 10, 15, 16, 40, 700])
def test_short_documents_fill_sequences(size):
    """With the query's limits, of any size of documents."""
    packer = packing.Packer(packing.Limits())
    n = max(60, 40_000 // size)
    seqs = [s for i in range(n) for s in packer.add(packing.Item(i, bytes(4 * size), size))] + list(packer.finish())
    lengths = [sum(len(p[2]) // 4 for p in s) for s in seqs]
    padded = sum(x if x & (x - 1) == 0 else 4096 for x in lengths)
    assert sum(lengths) == n * size and max(lengths) <= 4096 and sum(lengths) >= 0.98 * padded
    # only what is left at the end is shorter
    assert sum(x == 4096 for x in lengths) >= n * size // 4096 - 1


def test_formatted_conversations_are_packed_by_what_bears_loss(spark):
    """The spans that the chat operator gives are those that the packing operator counts."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    rows = [(c, i, ("user", "assistant")[i % 2], prose(10 + (7 * c + 13 * i) % 60, 100 * c + i)) for c in range(25) for i in range(4)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    docs = made.select(F.col("conv_id").alias("doc_id"), F.col("formatted").alias("text"), "loss").coalesce(1)
    got = packing.pack(docs, tokenizer(), packing.Limits(tokens=512, segments=6, loss=150, window=8), loss="loss").collect()
    mask = {}
    for r in docs.collect():
        at = t.encode(r.text, add_special_tokens=False).offsets
        mask[r.doc_id] = [any(x < s["end"] and y > s["start"] for s in r.loss) for x, y in at] + [any(s["end"] >= len(r.text) for s in r.loss)]
        said = "".join(r.text[s["start"] : s["end"]] for s in r.loss)
        assert chat.unescape(said) == "".join(x for c, i, role, x in rows if c == r.doc_id and role == "assistant")
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    for s in sequences.values():
        bears = sum(sum(mask[r.doc_id][r.start : r.start + r.length]) for r in s)
        assert sum(r.length for r in s) <= 512 and len(s) <= 6 and bears <= 150
    assert sum(r.length for r in got) == sum(map(len, mask.values()))
    # the loss limit binds: tokens alone would take fewer sequences
    assert len(sequences) >= sum(map(sum, mask.values())) / 150 > sum(map(len, mask.values())) / 512

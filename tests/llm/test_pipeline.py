"""The pipeline, stage by stage, against plain versions of each stage on a small table."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from beatlake.llm import mixing, packing, queries, secrets, toxicity
from tests.llm.test_operators import brute_simhash, brute_spans, poisson, prose, roots

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = []
    for i in range(200):
        # every tenth document is followed by a near copy of its text
        t = prose(50, 5000 + i - 1) + "." if i % 10 == 1 else prose(50, 5000 + i)
        if i % 7 == 0:
            t += " idiot scum" if i % 2 else " moron trash"
        if i % 9 == 0:
            t += ' token = "abcdef123456"'
        rows.append((i, t, "en", f"src{i % 6}", len(t)))
    # null and empty texts, a repeated row, one id with two texts, a null source, a null id
    rows += [(501, None, None, None, None), (502, "", "en", "src1", 0), rows[3], (503, prose(40, 9001), "en", None, 1), (503, prose(40, 9002), "en", "src2", 1), (None, prose(40, 9003), "en", "src1", 1)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(150)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_run_like_plain_stages(spark, folder):
    from tokenizers import Tokenizer

    path, rows = folder
    got = corpus_pipeline.run(spark, path).collect()
    docs = sorted((r for r in rows if r[0] is None or r[0] % 7 or r[0] > 200), key=lambda r: (r[0] is None, r[0] or 0))  # toxic ones go
    root = roots(list(range(len(docs))), [brute_simhash(r[1]) for r in docs], 3)
    docs = [r for i, r in enumerate(docs) if root[i] == i]

    def masked(text):
        if text is None:
            return None
        out, at = "", 0
        for a, _, z in brute_spans(text):
            out += text[at:a] + secrets.MASK
            at = z
        return out + text[at:]

    docs = [(*r[:1], masked(r[1]), *r[2:]) for r in docs]
    mass = {}
    for r in docs:
        k = r[3] if r[3] in mixing.WEIGHTS else None
        mass[k] = mass.get(k, 0) + len(r[1] or "")
    t = Tokenizer.from_file(queries.tokenizer())
    want = {}
    for r in docs:
        k = r[3] if r[3] in mixing.WEIGHTS else None
        rate = mixing.WEIGHTS.get(k, mixing.OTHER) * sum(mass.values()) / mass[k]
        u = int(hashlib.md5(f"{mixing.SEED}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:12], 16) / 16**12
        if n := poisson(u, rate):
            want[r[0]] = want.get(r[0], 0) + n * (len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1)
    mine = {}
    for r in got:
        mine[r["doc_id"]] = mine.get(r["doc_id"], 0) + r["length"]
    assert mine == want
    lengths = {}
    for r in got:
        lengths[r["sequence_id"]] = lengths.get(r["sequence_id"], 0) + r["length"]
    assert all(n <= 4096 and n & (n - 1) == 0 for n in lengths.values())


def test_stages_keep_the_columns(spark, folder):
    path, _ = folder
    clash = ("copies", "rate", "copy_no", "mix_key", "spans", "text_key", "is_toxic", "p_toxic", "fp", "row", "raw", "id", "c0")
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({c: F.lit("clash") for c in clash})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.where(" or ".join(f"{c} <> 'clash'" for c in clash)).count() == 0
        assert stage(spark, docs.limit(0), path).count() == 0
    assert set(packing.PIECES.names) < set(corpus_pipeline.STAGES[-1][1](spark, docs, path).columns)


def test_clean_documents_stay(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, path).collect()}
    assert kept == {r[0] for r in rows if r[0] is None or r[0] % 7 or r[0] > 200}
    assert toxicity.THRESHOLD == 0.5


def test_registered(spark):
    q = queries.queries()
    assert [k.split("_")[0] for k in q] == [f"op{i}" for i in range(1, 14)] + ["pipeline"] and set(queries.oracle_sql()) <= set(q)
    assert all(map(callable, q.values()))

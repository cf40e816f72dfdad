"""The registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatlake.llm import ann, chat, langid, lexical, mixing, oracle, outliers, packing, repair, secrets, simhash, site_quality, suffix_dedup, toxicity
from beatlake.llm.common import table
from beatlake.session import with_package


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "copies", "copy_no", F.round("rate", 6).alias("rate"), "mix_key", "text")


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit(spark, docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain, ["doc_id"]).withColumn("kept", ~F.col("is_toxic"))


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(spark, docs))


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages. Pages have the host and first path segment of their URL; documents have no URL, so a document's source is its host.

    A page's doc_id is -1 - page_id, so it can't be a document's.
    """
    pages = table(spark, sf_dir, "pages")
    host, path = site_quality.site_of(F.col("url"))
    web = pages.select((-1 - F.col("page_id")).alias("doc_id"), site_quality.visible_text(F.col("html")).alias("text"), host.alias("host"), path.alias("path"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"), F.lit(None).cast("string").alias("path"))
    return site_quality.classify(spark, docs.unionByName(web), table(spark, sf_dir, "labels"), F.col("host"), F.col("path"))


def op8_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-7).cast("bigint").alias("conv_id"), F.lit(i).cast("bigint").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text")) for i, role in enumerate(("user", "assistant"))))).alias("r")).select("r.*")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_conversations(turns))


def op9_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = outliers.verdicts(spark, outliers.statistics(table(spark, sf_dir, "documents")))
    return out.select("doc_id", *outliers.COUNTS, "base_failed", "kept", F.round("distance", 6).alias("distance"))


def op10_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(spark, table(spark, sf_dir, "documents"))
    number = secrets.KINDS.index
    base = F.filter("spans", lambda s: ~s["link"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == number(kind))).cast("bigint")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in secrets.KINDS[:3]),
        F.sha2(secrets.listing(base), 256).alias("base_sha256"),
        secrets.listing(F.col("spans")).alias("spans"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with faults that follow a checksum of their place: dropped, emptied, without full stops, said twice, or of another role."""
    place = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    given = turns.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(place.cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    return given.where("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("n")).drop("n")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair.Repair(spark, damaged(turns)).conversations().withColumnRenamed("conv_id", "of")
    every = turns.select("conv_id").distinct()
    out = every.join(found, every.conv_id.eqNullSafe(found.of), "left").drop("of")
    return out.na.fill(0, ["gaps", *repair.COUNTS, "cost"]).withColumns({"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))})


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.digests(suffix_dedup.Repeats(spark, docs).removed())
    return suffix_dedup.of_documents(docs, found, ("n_bytes", "n_removed", "n_spans", "kept_sha256")).drop("text")


def op13_wand_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def queries() -> dict:
    import corpus_pipeline

    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    ordered = sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0]))
    return {k: with_package(f) for k, f in [*ordered, ("pipeline", corpus_pipeline.run)]}


def oracle_sql() -> dict[str, str]:
    return oracle.ORACLES

"""Toxic documents go, near-duplicates are folded, secrets masked, sources mixed, and what is left is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from beatlake.llm import mixing, packing, queries, secrets, simhash, toxicity
from beatlake.llm.common import table
from beatlake.scratch import Scratch
from beatlake.session import with_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = toxicity.fit(spark, docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, chain)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(spark, docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.tokenizer())


STAGES = [
    ("toxicity", with_package(drop_toxic)),
    ("near_duplicates", with_package(drop_copies)),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
    ("pack", with_package(pack_sequences)),
]

#: The trained chain and the tokenizer can't be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`, each reading what the one before it wrote."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = scratch.save(docs)
    return docs

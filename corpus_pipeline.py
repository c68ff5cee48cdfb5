"""Raw documents to token ids: quality, lines, near-duplicates, benchmark leaks, encoding.

Every stage takes the documents that its predecessor kept and returns documents, the
last one token ids.  A null doc_id cannot name a document: such rows go through the
stages that decide by text alone, and stay in those that remove documents by id.  Rows
that share a doc_id are one document and stay or go together.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaflow.llm import bpe, decontaminate, line_dedup, resampling, simhash
from taxaflow.llm.common import documents, fresh
from taxaflow.session import durable, ship_package

#: No SQL counterpart: hashes, latent search and byte-pair merges are tested against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling; the labels are the target."""
    ship_package(spark)
    sampler, _ = resampling.fit(docs, documents(spark, sf_dir, "labels"))
    key = sampler.key("doc_id", "text", sampler.log_weight("text"))
    name = fresh(docs, "key")
    return docs.withColumn(name, key).where(sampler.drawn(F.col(name))).drop(name)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more of them repeat, but for the last holder."""
    ship_package(spark)
    name = fresh(docs, "lines")
    cut = line_dedup.drop_lines(docs, into=name).withColumn("text", F.col(f"{name}.text"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates."""
    ship_package(spark)
    groups = simhash.similar_documents(docs.select("doc_id", "text"))
    return docs.join(groups.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship_package(spark)
    found = decontaminate.leaks(docs.select("doc_id", "text"), documents(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each document, and digests of the ids and of the text decoded from them."""
    ship_package(spark)
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("byte_level_bpe", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each reading what the one before has written."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = durable(docs)
    return docs

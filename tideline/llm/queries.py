"""Queries of the corpus operators for the driver: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import bpe, exact, langid, packing, quality, repair, simhash, substring, toxicity, vecgraph
from tideline.llm.common import table, tokenizer_path


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.deduplicated(table(spark, sf_dir, "documents"), removed="removed")
    return found.select("doc_id", F.length("text").alias("n_kept"), F.size("removed").alias("n_removed"), "removed", "text")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predicted(docs, langid.learn(docs))


def op2_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards, _ = repair.write_shards(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return repair.read_documents(shards)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_vecgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecgraph.linked(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_langid, op2_repair, op3_packing, op4_toxicity, op5_substring, op6_exact_dedup, op7_simhash, op8_quality, op9_bpe, op10_vecgraph)}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_exact_dedup": """
            WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len,
                              regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents)
            SELECT doc_id,
                   first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size,
                   doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS kept,
                   sha256(norm) AS text_sha256
            FROM n""",
    }

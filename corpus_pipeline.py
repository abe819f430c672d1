"""A corpus pipeline in five stages: toxicity, exact copies, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result to the shared folder
as Parquet and reads it back for the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import exact, packing, simhash, substring, toxicity
from tideline.llm.common import discard, fresh, table, tokenizer_path, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier, fitted on the labels, does not reject."""
    return toxicity.without_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_exact_copies(docs)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles have a similarity of 0.8 or more."""
    return simhash.drop_near_duplicates(docs, similarity=0.8, shingle=5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines and sentences that an earlier document has; n_chars follows the text."""
    removed = fresh(docs, "_removed")[0]
    out = substring.deduplicated(docs, removed=removed)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids."""
    return packing.packed(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", reject_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_similar), ("substring_dedup", cut_repeats), ("packing", pack)]

#: Classification, similarity and packing have no SQL form; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, new = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if path:
            discard(spark, path)
        path = new
    return docs

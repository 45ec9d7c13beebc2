"""A training-data pipeline over `documents`: language, quality, near copies, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import bpe, decontaminate, langid, omh, quality
from evidentia.llm.queries import table
from evidentia.llm.runtime import fold, new_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language; texts without a letter go."""
    return langid.accept(docs, langid.sample(docs, fold("doc_id", 4) != 2))


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier scores 0.5 or more."""
    return quality.accept(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return omh.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap with a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("quality", good_text), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe", tokens)]

#: Trained models and edit distances have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

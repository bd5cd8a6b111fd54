"""The corpus pipeline: from raw documents to token counts, each stage one operator of heddle.llm.

A stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents. An empty table goes through all stages; nulls in any column are
kept (a null text counts as empty, so of those with null or blank texts exact dedup keeps one of
each); extra columns come along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heddle.llm import bpe, decontamination, exact_dedup, jaccard_join, shared, toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose expected severity reaches toxicity.REJECT."""
    return toxicity.acceptable(docs, shared.table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the row with the smallest doc_id."""
    return exact_dedup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of texts whose five-word shingles are 0.8 similar."""
    return jaccard_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with an occurrence of a benchmark window."""
    return decontamination.clean_documents(docs, shared.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.digests(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("ngram_jaccard", without_near_copies),
    ("decontamination", without_benchmark),
    ("bpe", tokens),
]

#: No SQL: it can't train the toxicity model or merge byte pairs; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.stored(stage(spark, docs, sf_dir), name)
    return docs

"""From raw documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationwise.llm import decontaminate, jaccard_join, pii_bootstrap, quality_rank, segment_bpe
from stationwise.session import use_utc, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise quality ranking accepts; it learns from labels whose crc32(doc_id as text) mod 5 is not 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return quality_rank.keep_good(docs, quality_rank.fit(docs, labels))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that of the smallest doc_id."""
    return jaccard_join.keep_one(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, n_chars as the new text has them."""
    masked = pii_bootstrap.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the ids of each document as little-endian unsigned 32-bit integers, with counts and digests."""
    out = segment_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)
    return out.drop("n_chars")


STAGES = [
    ("quality_rank", good_quality),
    ("jaccard_join", one_of_each),
    ("decontamination", clean_of_benchmark),
    ("pii_bootstrap", personal_data_masked),
    ("segment_bpe", token_ids),
]
#: SQL can express neither the ranking nor the merges. The operators' tests hold each of them against brute force; test_stages
#: looks at which rows leave, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = use_utc(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs

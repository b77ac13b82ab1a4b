"""The corpus pipeline: toxicity, exact de-duplication, near de-duplication, packing.

Each stage is (name, function); a function takes the session, the documents that the stage
before it kept, and the data folder, and gives a DataFrame that is written as Parquet and read
again as the next stage's documents. All stages but the last keep the columns of documents.

Defined results: every stage takes null and empty texts, repeated rows, empty tables and further
columns. Rows without an id pass the near-duplicate stage, since they cannot be named.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_file
from pyspark.sql import DataFrame, SparkSession

from blockweave.llm import exact_dedup, near_dedup, packing, toxicity
from blockweave.runtime import settle, spread, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, does not call toxic."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts, the one with the smallest id."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the document with the smallest id."""
    return near_dedup.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of each document, placed in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: SQL cannot express the classifier, the tokenizer or the packing; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

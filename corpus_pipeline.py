"""A corpus pipeline of five stages over documents.

Toxic documents go, then exact copies, then near copies (one of each class stays), the
sources are mixed to their target weights, and what is left is encoded. Each stage takes
(spark, docs, sf_dir), with docs as its predecessor wrote them; all but the last return
the columns of documents, whatever they are. Null text counts as empty and null sources are a
source; null and repeated ids and repeated rows are rows, of which the copy stages keep one
of each group. Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kestrane.llm import bpe, filters, mixing, toxicity
from kestrane.llm._common import docs_of, materialise, small_batches
from kestrane.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; the labels come from the table of that name."""
    small_batches(spark)
    return toxicity.without_toxic(docs, docs_of(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal up to white space."""
    return filters.without_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class linked by a Jaccard similarity of 0.8 or more on five-word shingles."""
    small_batches(spark)
    return filters.without_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, whole."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), ids_sha256, decoded_sha256 of each document."""
    small_batches(spark)
    return bpe.bpe_digest(docs, tokenizer("word_bpe_49k.json"), ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Nearest neighbours, sampling and encoding are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read back before the next."""
    docs = docs_of(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The registered queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ._common import docs_of


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_scan

    return secret_scan(docs_of(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(docs_of(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(docs_of(spark, sf_dir)).drop("t1", "t2")


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprints

    return fingerprints(docs_of(spark, sf_dir))


def op5_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .arrow_output import token_id_output

    return token_id_output(docs_of(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(docs_of(spark, sf_dir))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .similarity_join import near_duplicates

    return near_duplicates(docs_of(spark, sf_dir))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import html_text

    return html_text(docs_of(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(docs_of(spark, sf_dir), docs_of(spark, sf_dir, "labels"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_digest

    return bpe_digest(docs_of(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import lexical_search

    return lexical_search(docs_of(spark, sf_dir), docs_of(spark, sf_dir, "benchmark"))


def op12_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hash_search import nearest_vectors

    return nearest_vectors(docs_of(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import alignment

    return alignment(docs_of(spark, sf_dir), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}

"""Documents to training tokens: rules, near-duplicates, repeated passages, mix, encoding.

Each stage works on all that the one before it kept, written as Parquet and read again. All but the
last return the columns of documents. Part of the subpackage llm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, mixing, quality_rules, simhash, suffix_dedup
from millrace.shared import scope, write_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the thresholds of their language and source keep."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: texts that share 0.8 or more of their five-word shingles."""
    return simhash.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of repeated passages of 200 bytes or more."""
    return suffix_dedup.drop_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each copy."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", passages),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: SQL can't express the stages' hashes and merges. Tests compare each operator with a brute-force version
#: (rules, groups, passages, mix) or the tokenizer's library (encoding), and each stage with its operator.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        # What a stage writes on its way, and its input where that is a stage's output, goes once its output stands.
        with scope(spark, docs) as keep:
            docs = keep(write_table(stage(spark, docs, sf_dir), f"stage-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)

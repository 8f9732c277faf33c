"""The corpus pipeline: language ID, quality rules, near-duplicate removal, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns what the next one gets; all but the last return documents with the
columns they came with. Written tables stand between stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from priorlens.llm import stages
from priorlens.llm.common import drop_stored, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language (null texts and texts without a letter); the others are labelled as predicted."""
    return stages.identified(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or diverge from the language they were found to be in."""
    return stages.fit(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    return stages.distinct_texts(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources meet their target weights, in training order."""
    return stages.mixed(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, digests of the encoded and the decoded text, and the training rank of every row."""
    return stages.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language_id),
    ("quality rules", quality_rules),
    ("MinHash near-dedup", minhash_dedup),
    ("mixing to target weights", mix_sources),
    ("byte-level BPE", encode_bpe),
]

#: SQL can't express the stages (suffix automata, BPE); tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, old = stored(docs, f"stage-{k}"), before
            before = docs
            if old is not None:  # what the stage has read isn't read again
                drop_stored(old)
    return docs

"""A corpus pipeline of five stages over ``documents``.

Rejects documents of poor quality, removes cross-site boilerplate lines, keeps one document of
each group of near copies (fingerprints of five-word shingles, similarity 0.8 or more), mixes the sources to their
target weights, and packs what is left into token sequences. Each stage's result is written as
Parquet and read again by the next, and a stage's table is deleted once the next is written.

Rows: each row is decided on its own, whatever its id; null texts count as empty; without labelled
rows no document is rejected; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sonaria.llm import lines, mixing, packing, quality, similar
from sonaria.llm.common import Written, table


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (6), fitted on ``labels``, does not reject; all without labels."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on five sources or more, but for their first place (7)."""
    return lines.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: fingerprints of five-word shingles by the index of (1), bands for what they leave apart, 0.8 or more verified."""
    return similar.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights (10) takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of 2048 tokens (5)."""
    return packing.pack(docs, public_tokenizers.path(packing.MODEL))


STAGES = [
    ("quality", select_quality),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage reads the table that the one before it has written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        made = Written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            last.drop()
        docs, last = made.df, made
    return STAGES[-1][1](spark, docs, sf_dir)

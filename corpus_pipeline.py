"""A corpus pipeline of five stages. Each takes what the stage before it kept and gives documents, the last one packed sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textfacts.llm import decontaminate, packing, secrets, simhash, toxicity
from textfacts.llm.common import bounded_batches, discard, stored, table, tables_written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go. Null and empty texts stay."""
    bounded_batches(spark)
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with 0.8 or more of their five-word shingles in common, the document of the smallest id stays."""
    bounded_batches(spark)
    return simhash.without_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item stands go. Null and empty texts hold none and stay; repeated rows go or stay together; no items drop nothing, no documents give none."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, repeated rows too; secret values in their texts are replaced. Null texts stay null, empty ones empty."""
    bounded_batches(spark)
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in training sequences, with their ids. A null or empty text is a piece of the end's id alone; repeated rows are packed as often as they come; no documents give no pieces."""
    bounded_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Tokenizing, edit distances and the fitted classifier are beyond SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the table documents, each one's result written and read again. What a stage wrote for itself, and its input, are deleted when its result stands."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with tables_written() as own:
            docs = stored(stage(spark, docs, sf_dir))
        discard(spark, before + own[:-1])
        before = own[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)

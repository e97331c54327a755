"""The corpus pipeline: each stage takes the documents that the one before kept, written as Parquet and read again.

In every stage null and empty texts are texts of no words (never toxic, one group of near-duplicates, nothing to redact, no
tokens), null ids and repeated rows are rows like others, extra columns stay but in the last, and an empty table gives an
empty one. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe, mixing, pii, simhash
from foliant.llm import toxicity as toxicity_operator
from foliant.llm.common import path_of, settled, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that a lexicon learned from the labels calls toxic; without labels none."""
    return toxicity_operator.clean(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near-duplicates; rows decide, so ids may repeat."""
    return simhash.deduplicated(docs)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data, open or disguised, by marks; n_chars follows the text."""
    return pii.redacted(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that each source comes near its target of words."""
    return mixing.copied(docs, mixing.word_count(F.col("text")))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, a row per copy."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, with_ids=True).withColumnRenamed("key", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("pii_redaction", pii_redaction),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]
#: SQL can't express learned weights, covering hashes or merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}", drop=before)  # the table before is read no more
        before = [path_of(docs)]
    return STAGES[-1][1](spark, docs, sf_dir)

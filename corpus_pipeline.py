"""The corpus pipeline: an ordered list of stages over documents, each written and read again.

Toxic documents go; of each group of near copies one stays; passages of 13 words and more that
an earlier document has are cut; documents that hold a benchmark item go; the rest is encoded.

Every stage judges each row by its own text: rows with a null or a repeated doc_id are kept or
dropped like any other (only cutting and grouping need an id: a null one is never a copy). Null
and empty texts stay, as there is nothing in them to drop, and have no tokens. Texts are taken
whole, whatever their length; an empty table stays empty; extra columns pass, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import bpe, decontaminate, near_dup, substring_dedup, toxicity
from ledgerline.llm.tables import table
from ledgerline.workdir import staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labels that are not held out; drop rows that are predicted toxic. Without labels nothing is."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays; rows that repeat it whole stay with it."""
    return near_dup.dedup(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words and more that a document with a smaller doc_id has are cut; rows that lose every word go."""
    return substring_dedup.remove_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item at a weighted similarity of 0.75 go; an empty benchmark drops nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes, a row each."""
    return bpe.fingerprints(docs, bpe.default_codec(spark))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("bpe", tokenize),
]

#: SQL cannot say the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

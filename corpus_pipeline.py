"""A corpus pipeline over ``documents``: five stages, each by one operator of ``aislewise.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``docs``. ``run`` writes every stage's result as Parquet to the shared checkpoint folder
and reads it back as the next one's input, so a lost executor repeats tasks of one stage at most.

Defined cases: a document with a null or empty text fails the quality rules; very long texts go through
every stage whole, in slices of their own; null and repeated ids are treated as the stages' operators
say; of near copies with equal ids one row stays, and of equal rows one; an empty table passes through;
extra columns, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewise.llm import bpe_pairs, edit_decontam, minhash_dups, pii_disclosure, quality_rules
from aislewise.llm.common import default_tokenizer, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the least id, of each group of near copies (similarity 0.8 or more)."""
    return minhash_dups.keep_one(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return edit_decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and disclosing terms replaced in their texts."""
    clean = pii_disclosure.sanitise(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, number of tokens and token ids of each document."""
    return bpe_pairs.encode_texts(docs, default_tokenizer("word_bpe_49k.json"), columns=("n_tokens", "ids")).withColumnRenamed("id", "doc_id")


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("pii", sanitise), ("bpe_encoding", encode)]

#: SQL has neither edit matching over all rows nor merges by rank: the result is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

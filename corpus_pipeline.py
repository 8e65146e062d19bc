"""From raw documents to token ids: drop poor texts, copies and near copies, mix the sources, encode.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read
again as the ``docs`` of the next. All but the last return the columns of ``documents``, and any others that their
input has, whatever their names; all take an empty table to an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foliant.llm import byte_bpe, exact_dedup, jaccard, mixing, quality
from foliant.runtime import Scratch, drop_tables, mark


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to the labels, does not reject.

    Rows are judged each by its text: repeated rows share their verdict, null and empty texts go or stay by the
    model's bias, ties at the threshold stay, null ids are ordinary rows. Without usable labels all rows stay.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id.

    Null texts count as empty: one of them stays. Of rows that repeat id and text one stays; null ids are smallest.
    """
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component at five-word shingles and a similarity of 0.8, the one with the smallest id.

    Texts without words and rows without id stay; of rows that repeat an id each is judged by its own text.
    """
    return jaccard.keep_one(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; copies keep their id.

    Null sources are one source; texts without words are taken 0 times or more by their source's rate, as they add
    no words; rows that repeat id and size are taken equally often.
    """
    return mixing.take_copies(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests of the ids and of the decoded bytes; a null text has no ids."""
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [
    ("quality_classifier", drop_poor),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: A learned score and components of links have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's intermediate tables go when its output has been written."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        since = mark()
        kept = stage(spark, docs, sf_dir)
        made = mark()
        out = scratch.keep(kept, name)
        drop_tables(spark, since, made)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)

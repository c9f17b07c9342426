"""A corpus pipeline of five stages over the documents; part of the corpus operators.

Each stage works on what its predecessor kept, written as Parquet and read again. All but the last
return the columns of the documents, whatever others there are and whatever their names.

Null and empty texts have no words: the quality rules reject them, and so each later stage would
keep or drop them by its own docstring. Null ids pass; a null language is a stratum of its own, a
null source the last source. Very long texts are worked on whole. Rows that are repeated as they are
become one in the near-duplicate stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bpe, mixing, neardup, rules, toxicity
from graphloom.llm.common import read, shared_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    labels = read(spark, sf_dir, "labels")
    return rules.keep_good(docs, labels)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below their language's threshold."""
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets: whole documents, as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and digests of the ids and of the text they decode to."""
    return bpe.digest_documents(docs, with_ids=True)


STAGES = [("quality rules", quality_rules), ("toxicity", toxic), ("minhash near-dedup", near_duplicates), ("mixing sources", mix_sources), ("bpe", encode)]

#: Trained scores and ProbMinHash can't be expressed in SQL; the tests hold each stage of a run, and its result, against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the table documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

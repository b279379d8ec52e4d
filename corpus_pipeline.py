"""A corpus from raw documents to token files: five stages, each over all that the one before kept.

All stages but the last return the columns of documents, whatever else a table has; each takes empty tables, null ids and
texts, very long texts and repeated rows, as its docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factspark.llm import cotrain, mixing, queries, sigtree, suffix
from factspark.llm.common import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts: of good quality and not toxic.

    Null texts are judged as empty ones, null metadata as a value of its own; repeated rows are judged alike and all stay
    or go. Without labels of both kinds all documents have one probability, a half if there are no labels: they stay.
    """
    return cotrain.keep_accepted(docs, cotrain.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles are linked at a Jaccard similarity of 0.8: the smallest id's, and of
    repeated rows of it that with the smallest text. Rows without id and documents without words link to nothing and stay."""
    return sigtree.keep_one(docs, 5, 4, 5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of 8 words with a benchmark item. Null texts share none; of repeated rows all go or
    stay; an empty benchmark keeps all."""
    return suffix.decontaminate(docs, suffix.read_items(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the budgets of the domain-language-source tree pay for: nine tenths of all tokens, each once.

    Null languages and sources are nodes of their own; documents without words cost nothing; repeated rows count each.
    """
    found = mixing.mix(docs, queries.MIX_LEVELS, share=0.9, weights=queries.MIX_WEIGHTS, epochs=1, seed=17)
    return found.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents, and what is read back from them. A null text is empty; each of repeated rows has its
    place; rows without id come first."""
    return queries.token_files(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL can't express training a classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written, and read as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

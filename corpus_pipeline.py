"""A training corpus from raw documents: five stages, each written and read again.

Stages 1 to 4 return the columns of documents; the last returns one row per
packed piece. Every stage works on all rows that the one before it kept.

Edge cases: a null or empty text fails the quality rules. Rows without a doc_id, lang or source go through all stages like others:
their languages are told from their texts, a null source is a source of its own. Of rows of one group of near duplicates one stays, repeated rows and
rows without an id included: that of the smallest doc_id, null last; of equal ones any one. Then the mix may repeat it. Very long texts are
worked on whole. Extra columns pass through the first four stages, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinleaf.llm import language_id, mixing, ngram_join, packing, quality_rules
from twinleaf.llm.tables import table
from twinleaf.operators.storage import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a quality rule rejects."""
    return quality_rules.quality_filter(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language that can be told."""
    return language_id.language_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return ngram_join.one_of_each_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents until the sources have their target weights."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [("quality rules", quality), ("language ID", language), ("n-gram Jaccard join", near_duplicates), ("mixing", mix), ("best-fit packing", pack)]

#: The language model, shingle sets and packing can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{k}")
    return docs

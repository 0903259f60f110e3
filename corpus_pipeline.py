"""Corpus pipeline: five stages over the documents, each the next one's input.

A stage is (name, function of (spark, docs, sf_dir)); its result is written as
Parquet and read again.  All but the last return the columns of documents.

Every stage takes nulls in any column, empty and very long texts, ties,
repeated rows, empty tables and further columns with any names; what it does
with them is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm.common import cut, table
from cohortlens.llm.decontaminate import remove_contaminated
from cohortlens.llm.jaccard_join import one_of_each
from cohortlens.llm.mixing import mixed_rows
from cohortlens.llm.sharding import shard_rows
from cohortlens.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a model learnt from the labelled ones rejects; texts without words and unlabelled ids are judged like others."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar ones: the smallest id, null ids last, then the first row; texts without words all stay."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with benchmark passages; texts without words stay, repeated rows are judged one by one."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the sources meet their target weights; null is a source, texts without words weigh nothing."""
    return mixed_rows(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Random order in shards of equal row counts; adds size, text_crc32, shard and slot; null texts have size 16, null ids go by their place."""
    return shard_rows(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: No SQL: the first stage fits a model, the fourth solves by iteration, the last one shuffles with a NumPy generator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage reads what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

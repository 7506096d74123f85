"""A training corpus from `documents`: the operators of driftwell.llm in a row, each stage on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftwell.llm.decontamination import decontaminate
from driftwell.llm.language_id import keep_identified, learn
from driftwell.llm.mixing import mixed_documents
from driftwell.llm.near_duplicates import keep_distinct
from driftwell.llm.shared import Scratch, table
from driftwell.llm.sharding import with_shard

SHARDS = 16


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter (null and empty texts too), or undecided between languages, go. The trees learn from
    the rows that have a label; where none has, all go."""
    return keep_identified(docs, learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id; equal rows count as one. Rows without
    an id stay only where no row of their group has one; texts without words stay."""
    return keep_distinct(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; texts without words, and all where the benchmark is empty,
    stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it: not at all, once or twice. A null source is a source; texts
    without words stay once."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard; null and empty texts have one, too."""
    return with_shard(docs, SHARDS)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: SQL can't state the context trees of the first stage; tests hold each stage's rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as a table and read again. An empty table gives no rows."""
    scratch = Scratch(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs

"""A training corpus from raw documents, stage by stage.

Every stage takes the documents its predecessor kept and returns documents;
``run`` writes each result as Parquet in the shared folder and reads it again,
so a lost executor never costs more than the stage it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairsmith.llm.decontam import decontaminate
from pairsmith.llm.mixing import mixed_docs
from pairsmith.llm.quality_rules import keep_good
from pairsmith.llm.sharding import shuffle_into_shards
from pairsmith.llm.simhash import near_dedup
from pairsmith.session import read_table, stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class."""
    return near_dedup(docs, size=4, max_bits=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages they share with benchmark items."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents left out, or repeated."""
    return mixed_docs(docs, weights=(5, 2, 1))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard (0 to 15) and slot."""
    return shuffle_into_shards(docs, 16)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Learned rules, XXH64 fingerprints and the hypergeometric draw have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"corpus-{name}")
    return docs

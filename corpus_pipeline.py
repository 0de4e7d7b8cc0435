"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, shards.

Every stage takes the rows its predecessor kept, as reread Parquet. All but the last
return the columns of documents; the last adds each row's shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridtrend.llm import curriculum, decontaminate, host_rules, sharding, simhash
from gridtrend.llm.common import new_folder, release, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or whose host is rejected go."""
    return host_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return simhash.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, in training order."""
    return curriculum.training_order(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its size, text checksum, shard and slot."""
    return sharding.sharded(docs)


def _fresh(stage):
    """A stage begins when the result of the one before is written: what that one has
    kept in the shared folder is removed first."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality rules", _fresh(quality_rules)),
    ("simhash near-dedup", _fresh(near_dedup)),
    ("decontamination", _fresh(decontamination)),
    ("mixing", _fresh(mixing)),
    ("sharding", _fresh(shards)),
]

#: Fingerprints, label propagation and item windows are not expressible in SQL; the
#: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, released=False)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs

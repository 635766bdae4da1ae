"""A corpus in five stages: quality rules, near duplicates, benchmark leaks, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``, extra ones and any names included. Between stages the rows are written as Parquet and read again.

For every stage: an empty table gives an empty one; very long texts are judged whole; rows are judged each on
its own, so repeated rows and rows that share a doc_id never take each other along, except as near duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelworks.llm import decontam, mixing, quality, sharding, sigtree
from panelworks.llm.common import new_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep. Null and blank texts go, and so does any of fewer than 50 words."""
    return quality.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents that share 80% of their 5-word shingles: that with the smallest doc_id.

    Of repeated rows one stays, null doc_ids come last, texts without words all stay."""
    return sigtree.one_of_each(docs, shingle=5, num=80, den=100)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item. Null texts stay; null and empty items find nothing."""
    return decontam.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Documents without words are not taken; a null source is the last source;
    ties between documents of one length are decided by a seeded hash."""
    return mixing.mixed_rows(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row of the mix goes. A null doc_id is a key like any other; repeated rows get slots of their own."""
    return sharding.shard(docs, 16)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("mixed_sources", mixed_sources), ("shards", shards)]

#: EM, and the seeded choice of the mix, have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to shards of a training corpus.

Each stage works on all rows that the stage before left.  All stages but the last
return the columns of ``documents``; the last adds each row's shard and bytes.
``run`` writes every stage as Parquet to the shared folder and reads it again, so a
lost executor costs a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adsift.llm import decontamination, jaccard_join, mixing, quality_model, sharding
from adsift.llm.common import private, read_table, stage


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return quality_model.good_documents(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at 0.8, one document stays."""
    return jaccard_join.one_of_each_group(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontamination.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is cut or repeated to its target; a row for each time taken."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their shard, none above the byte limit."""
    sharded = sharding.assign_shards(docs, shard=private(docs, "shard"))
    return sharded.withColumn(private(docs, "n_bytes"), sharding.row_bytes(sharded))


STAGES = [
    ("quality classifier", classify_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_passages),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

#: SQL cannot express the fitted classifier; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{k}")
    return docs

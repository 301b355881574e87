"""A training corpus from ``documents``: rules, near-duplicates, benchmark passages, source weights, shards.

Each stage works on all rows that the one before kept; all but the last return the columns of ``documents``, whatever their types and
names. An empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, mixing, near, quality, sharding
from tidemark.llm.common import fresh, written

SHARDS = 8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the weighed rules reject go, null and empty ones among them; repeated rows fare alike, long texts are read whole."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts joined by pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, that with the smallest doc_id stays.

    SimHash blocks propose the pairs. Texts without words are one group; a null doc_id is larger than any other; of equal rows one stays.
    """
    return near.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a benchmark window go; texts without words stay, null benchmark items have no windows."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets the same expected number of rows, and all rows together as many as came in. The null source is a source; null keys count as ''."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its shard and its place in it (``shard`` and ``slot``, or these names after underscores if documents have them)."""
    shard, slot = fresh(docs, "shard", "slot")
    return sharding.number(sharding.assign(docs, SHARDS, "doc_id", shard), shard, "doc_id", ("text",), slot)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("shards", shards),
]

#: The estimates of the rules, and fingerprints by XXH64, are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

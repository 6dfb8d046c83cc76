"""The corpus pipeline: quality rules, near copies, test items, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and returns the columns of `documents`; the last returns each row's shard.

Defined cases of every stage: an empty table gives an empty result; further
columns, whatever their names, are handed on by all but the last stage, which
returns ids and shards; ids may be null, repeated or of any type with an order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from statewise.llm import decontamination, jaccard_join, mixing, quality_rules, sharding
from statewise.llm.shared import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep; texts without words (null, empty) and repeated rows are judged like any other, the former go."""
    return quality_rules.keep_by_rules(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the least id; rows without a word are in no group and stay."""
    return jaccard_join.drop_near_copies(docs)


def test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of `benchmark`; rows without a word hold none."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, so an id may stand up to three times; rows without a word stay once, a null source is a source."""
    return mixing.apply_mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and slot; equal texts share a shard, a null text is a group of its own."""
    return sharding.shard_groups(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", rules),
    ("jaccard_join", near_copies),
    ("decontamination", test_items),
    ("mixing", mix_sources),
    ("sharding", shards),
]

#: Hash draws and best-fit packing have no SQL form; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stage's rows written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = written(docs)
    return docs

"""A corpus pipeline of five stages over `documents`: rules, near-duplicates, repeats, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each stage's result as
Parquet into the shared folder and rereads it. All but the last stage return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seriesforge.llm import common, mixing, packing, quality_rules, simhash, suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the n-gram regression, learnt on the given documents' labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.kept(docs, quality_rules.QualityRules().fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id."""
    return simhash.deduplicated(docs, bits=4, width=4)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that start earlier in the corpus."""
    return suffix_dedup.without_repeats(docs, width=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.taken(docs, weights=(5, 2, 1), cap=3)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096)


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("repeats", repeats), ("mixing", mix), ("packing", pack)]

#: No stage can be written as DuckDB SQL: a fitted regression, XXH64 with a seed, byte-wise repeats, a convex dual, a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs

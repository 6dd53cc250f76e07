"""A training corpus from documents: quality rules, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs.
Mixing orders the rows it writes; packing fills the batches of each bucket in that order.

Odd rows: a null text counts as empty, fails the quality rules for want of words, and so leaves at the first stage. A text
of any length passes whole; one that is nothing but repeated passages stays as an empty text, which packing places with
no tokens. Rows with a null id have no name to be grouped by and stay near-duplicates of nothing. Of repeated rows with
one id the second stage keeps one; of documents that are equally good to keep, that with the smallest id. Sources without
rows get no slots, a null source is a source of its own. Empty tables give an empty result, a table without labels leaves
the base rules only. Further columns are carried along to the mixed documents, whatever their names (also _metadata); the
last stage returns its own columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pactlake.llm import mixing, packing, quality_rules, simhash_dedup, suffix_dedup
from pactlake.llm.common import shared_dir, stored_order


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def mixing_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_mixed_order(docs)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, order=stored_order(docs))


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing", mixing_order),
    ("packing", batches),
]

#: SQL has neither XXH64 nor the schedule, so the pipeline is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

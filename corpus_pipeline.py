"""A corpus pipeline of five operators. Each stage is written as Parquet and read again by the next one."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from terralex.llm import chunk_bpe, curriculum, host_rules, signature_join, toxic_spans  # noqa: E402
from terralex.llm.common import partitions_for, text_volume  # noqa: E402
from terralex.session import materialise, ship_package  # noqa: E402


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return host_rules.keep_documents(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return toxic_spans.keep_documents(docs, toxic_spans.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return signature_join.keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    size, _ = text_volume(docs)
    return curriculum.training_order(docs, partitions_for(spark, size, 64 << 20))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship_package(spark)
    return chunk_bpe.encode_documents(docs, chunk_bpe.ChunkSettings(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("bpe", bpe)]

#: A trained model and a tokenizer decide rows here, which SQL cannot express; tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs

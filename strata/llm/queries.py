"""Queries over the driver's tables, one for each operator of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strata.llm import (
    binary_output,
    hashing_index,
    language_id,
    lm_score,
    mixing,
    parity_join,
    sentencepiece_codec,
    sharding,
    suffix_dedup,
    winnowing,
)
from strata.llm.common import prepare

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_output.encode_and_read_back(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.link_documents(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(table(spark, sf_dir, "documents"), share=1.0, max_epochs=3, weights=mixing.WEIGHTS)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op8_hashing_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing_index.nearest(table(spark, sf_dir, "embeddings"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprints(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_binary_output,
        op2_language_id,
        op3_sentencepiece,
        op4_parity_join,
        op5_suffix_dedup,
        op6_mixing,
        op7_lm_score,
        op8_hashing_index,
        op9_winnowing,
        op10_sharding,
    )
}

ORACLE_SQL: dict[str, str] = {}

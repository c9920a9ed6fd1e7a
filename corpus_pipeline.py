"""From raw documents to token ids: language, near copies, repeated passages, mixture, encoding.

Each stage takes what its predecessor kept, written as Parquet and read again, so a lost executor costs a task and a
failed run the stage it was in. Every stage takes documents with any further columns, whatever their names, and all but
the last return them as they are; nulls, repeated rows, empty and long texts and empty tables are handled as the
operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strata.llm import language_id, mixing, parity_join, sentencepiece_codec, suffix_dedup
from strata.llm.common import free, prepare, stored

#: Near copies share so many in a hundred of their distinct runs of so many words.
WORDS, SIMILAR = 5, 80
#: The mixture has this share of the tokens that reach it.
SHARE = 0.9
WEIGHTS = {"lang": {"en": 2.0}}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and those of whose evidence no language has a share of LEAST."""
    prepare(spark)
    return language_id.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one with the smallest doc_id stays; of rows with equal doc_id one."""
    prepare(spark)
    return parity_join.keep_one(docs, WORDS, SIMILAR, 100)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur more than once are cut out wherever they stand; no document is dropped."""
    prepare(spark)
    return suffix_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gives the tokens that its domain's, language's and own weight ask for, in one epoch."""
    prepare(spark)
    return mixing.mixed(docs, SHARE, WEIGHTS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids, round_trip, parity; null texts have no ids, repeated rows a row each."""
    prepare(spark)
    rows = sentencepiece_codec.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", "lang", "source", "n_tokens", "token_ids", "round_trip", "parity")


STAGES = [
    ("language ID", identify_language),
    ("near copies", drop_near_copies),
    ("repeated passages", cut_repeats),
    ("mixture", mix_sources),
    ("encoding", encode),
]

#: Learned models, seeded permutations and a tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        done = stored(stage(spark, docs, sf_dir), f"stage_{i}")
        if i:
            free(docs)
        docs = done
    return docs

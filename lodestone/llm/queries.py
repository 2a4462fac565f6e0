"""The registered query of each training-data operator, with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, decontaminate, jaccard, langid, oracles, pages, quality, sharding, simhash, toxicity
from lodestone.llm.common import table

VOCABULARY = "byte_bpe_50k.json"
SHARD_BYTES = 1 << 20


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op3_jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op4_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"), radius=3, every=100)


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), limit=512)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_page_text": op2_page_text,
    "op3_jaccard_classes": op3_jaccard_classes,
    "op4_extendible_shards": op4_extendible_shards,
    "op5_simhash": op5_simhash,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_language_id": op7_language_id,
    "op8_token_counts": op8_token_counts,
    "op9_toxicity": op9_toxicity,
    "op10_decontaminate": op10_decontaminate,
}

ORACLES: dict[str, str] = {
    "op3_jaccard_classes": oracles.CLASSES,
    "op4_extendible_shards": oracles.shards(SHARD_BYTES, 24),
    "op10_decontaminate": oracles.HITS,
}

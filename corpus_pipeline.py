"""A training corpus from raw documents, in five stages; each is one operator of lodestone.llm.

Every stage takes (spark, docs, sf_dir) and all but the last return the columns of documents; run() writes what a stage
returns and reads it again for the next.

Defined results, of every stage: an empty table gives an empty table; texts of any length are read whole; further columns
pass through whatever their names (the last stage leaves them out); rows of a null id, or of one id, are rows of their own.
What a stage does with null and empty texts, ties and repeated rows is said below.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, decontaminate, jaccard, langid, quality
from lodestone.llm.common import materialize, release, table
from lodestone.session import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine predicts good stay.

    Null texts are judged as empty ones, by structure alone; a score of 0.5 stays; of repeated rows all stay or all go.
    """
    ship(spark)
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte network knows with a score of 0.4 or more stay.

    Null texts and texts without a letter have no language and go; of equal scores the language that sorts first counts;
    of repeated rows all stay or all go.
    """
    ship(spark)
    return langid.keep(docs, least=0.4)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words and a similarity of 0.8 or more stays.

    It is that of the least id, of one id that of the least text hash, of equal rows one. Null texts and texts without a
    word belong to no group and stay, as do rows of a null id.
    """
    ship(spark)
    return jaccard.keep_first(docs, k=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words are cut out of the texts; documents that have no word left go.

    n_chars follows the text. Null texts and texts without a window stay as they are; of overlapping windows all words
    are cut; repeated rows are cut alike.
    """
    ship(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), size=10)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts; null texts count as empty, repeated rows each get a row."""
    ship(spark)
    return bpe.encode_digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", encoding_stage),
]

#: Two fitted models and a tokenizer are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
            release(*held)  # what the stage before it wrote
            held = [docs]
    return docs

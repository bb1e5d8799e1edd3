"""A training corpus from raw documents to token files. Each stage is written and read again before the next.

Every stage but the last keeps the columns of `documents`; the last returns one row a document of the files.

Null and empty texts go through: the classifier judges them by their length, near duplicates and decontamination leave them,
mixing takes none of their words, token files hold their end id alone. Rows with a null doc_id are never near duplicates. Of
rows that share a doc_id near duplicates keep one; mixing may repeat rows. Very long texts are worked on whole; equal texts
(ties) leave the smallest doc_id. Extra columns are carried, whatever their names. Empty tables give empty results; without
labels the classifier rejects nothing, without a benchmark nothing is contaminated.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, mixing, near_dedup, quality_classifier, token_files
from weftline.llm.common import Scratch, table
from weftline.llm.queries import TOKENIZER, VOCABULARY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.select_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.token_files(docs, public_tokenizers.path(TOKENIZER), VOCABULARY).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality_classifier", quality),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("token_files", tokens),
]

#: Trained models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

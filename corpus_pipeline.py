"""A training-data pipeline over ``documents``: language, near duplicates, personal data, mixture, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``, which the stage before kept. All but the
last return the columns they were given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import language, mixing, ngram_join, packing, pii
from pagemill.llm.queries import tokenizer_path
from pagemill.operators.joins import shared_folder
from pagemill.session import ship_package


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay."""
    ship_package(spark)
    return language.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    ship_package(spark)
    return ngram_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; all documents stay."""
    ship_package(spark)
    return pii.redact_documents(docs, pii.accepted_patterns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    ship_package(spark)
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the mixture, packed into sequences."""
    ship_package(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

ORACLE_SQL = None  # tokenizing, hashing into bands and learned patterns have no SQL form; tests/llm has brute force


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages in order; each but the last is written as Parquet and read again.

    They are written into ``folder``, a new one in the shared folder if none is given. The result reads the last of
    them: the folder can be removed when the result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = folder or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}-{name}")
            docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs

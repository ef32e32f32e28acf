"""The training-data pipeline: language identification, near-duplicate removal, sanitising and packing of `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet and reads them as the
next one's documents. All but the last return the columns of `documents`. The result is one row per packed piece.

Defined cases: a null or empty text, or one without a letter, has no language and goes in the first stage, as do null texts. Null ids
stay: they are no near duplicates of others, are sanitised like others, and are packed with a null id. Repeated rows are one
document for the second stage, which keeps one of them; ties there go to the smallest id, then the smallest text. Very long texts are read whole. Columns
beside text and n_chars pass as they are, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from taleweave.llm import langid, neardup, packing, pii
from taleweave.streaming.folders import shared_folder


#: The near-duplicate stage links documents of a likeness of 0.80; 14 of 32 values or fewer are then equal once in 150,900 pairs.
NEAR_PERCENT, NEAR_MATCHES = 80, 15


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a sufficient margin; `und` and narrow ones go."""
    return langid.keep_known(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates, of a likeness of 0.80 or more."""
    return neardup.keep_first(docs, NEAR_PERCENT, NEAR_MATCHES)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that reveal it replaced."""
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 2048, with the ids of each piece."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("language_identification", identify_language),
    ("near_deduplication", drop_near_duplicates),
    ("sanitising", sanitise),
    ("packing", pack),
]

#: Compression sizes, signatures and tokens can't be written in SQL; tests/llm holds run() against brute force, stage by stage and id by id.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

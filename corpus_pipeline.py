"""Corpus pipeline over documents: language ID, line dedup, near dedup, packing.

Each stage works on all that its predecessor kept; all but the last return the
columns of documents. Language models are learned from labelled documents of
the pipeline's own input.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespan.llm import language_id, line_dedup, near_dedup, packing
from wirespan.llm.common import materialised

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have letters and that some learned language codes in fewer bits than plain bytes take."""
    return language_id.reject_unknown(docs, language_id.train(docs))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document or line has; n_chars follows the text. Emptied documents go."""
    kept = line_dedup.without_repeated_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.one_of_each(docs, full_idf=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, each a sequence of a power-of-two length."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_languages),
    ("line_dedup", fresh_lines),
    ("near_dedup", distinct_documents),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each but the last returns is kept in the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialised(docs)
    return docs


#: Language models, near-duplicate groups and tokens are beyond SQL; the tests hold them against brute force.
ORACLE_SQL = None

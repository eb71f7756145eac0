"""A corpus from raw documents to packed sequences: each stage is written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import langid, linededup, nearsets, packing, quality, simhash
from trackloom.llm.common import WORD_PIECE_CHARS
from trackloom.plans.session import settle


#: Words that a packing worker remembers: the stages before leave executors whose heap is in use.
REMEMBERED = 100_000


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones of these, does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined: texts without letters and doubtful ones go."""
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier one exactly or within two edits; n_chars follows the text."""
    shorter = linededup.drop_repeated_lines(docs)
    return shorter.withColumn("n_chars", F.length("text").cast("bigint"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of SimHash fingerprints that links of 2 bits join; of those
    that stay, likewise one of each group of texts with 0.8 of their five-word shingles in common."""
    return nearsets.drop_near_duplicates(simhash.drop_near_duplicates(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 2048."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), remembered=REMEMBERED, held_chars=WORD_PIECE_CHARS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("language ID", language_filter),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("best-fit packing", pack),
]

#: SQL can state neither the classifiers nor the fingerprints; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

Language identification drops what it rejects, exact deduplication keeps the largest doc_id of equal texts, SimHash the
smallest of each component (near copies by five-word shingles are linked too), decontamination drops documents in which a benchmark item occurs; the last stage encodes what
is left. Every stage works on all that its predecessor kept and returns the columns of documents, but for the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brinewell.llm import bpe, decontam, exact_dedup, langid, near_copies
from brinewell.llm.common import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs)


STAGES = [
    ("language identification", identify_language),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("BPE encoding", encode),
]

#: Character models, fingerprints, alignment and merges have no SQL form; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs

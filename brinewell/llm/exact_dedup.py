"""Exact deduplication by a tree-merge of sorted digest runs, in DataFrame operations only.

Each task sorts the digests of its rows into a run and sums equal ones up. In every round the runs of 2^round_bits
neighbours meet (their numbers are shifted right), are merged in the order of their digests, and of each digest the
surviving identifier and the count stay, until one run is left; there are as many rounds as the number of runs asks for.
The identifier is a struct, which Spark aggregates over sorted input only, so that every level is a sort and a streaming
merge. What is merged of one digest arrives once per run, already summed, so that no task ever holds the rows of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, pick, without, written


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (SHA-256 of the normalised text), verify (a second hash and the length of the same text), run, raw (a hash of the text as it is)."""
    text = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return (
        pick(docs, "doc_id", "text")
        .select("doc_id", text.alias("t"), F.spark_partition_id().alias("run"), F.xxhash64("text").alias("raw"))
        .select("doc_id", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"), F.struct(F.xxhash64("t").alias("h"), F.octet_length("t").alias("n")).alias("verify"), "run", "raw")
    )


def rounds(runs: int, round_bits: int) -> int:
    """Rounds after which 2^round_bits neighbours merged in each leave one run."""
    return max(1, -(-max(0, runs - 1).bit_length() // round_bits))


def merge_runs(rows: DataFrame, keep: str = "max", round_bits: int = 3) -> DataFrame:
    """One row per distinct verified digest: digest, verify, keep_id, group_size.

    Digests that are equal but not verified by the second hash and the length stay apart at every level. A null doc_id is
    kept only if all of a group are null. Empty input: no rows.
    """
    last = rows.agg(F.max("run")).first()[0]
    known = F.col("doc_id").isNotNull()
    best, held = (F.max, known) if keep == "max" else (F.min, ~known)
    level = rows.select("run", "digest", "verify", F.struct(held.alias("known"), "doc_id").alias("id"), F.lit(1).cast("long").alias("group_size"))
    for _ in range(rounds(0 if last is None else last + 1, round_bits)):
        level = level.withColumn("run", F.shiftright("run", round_bits)).groupBy("run", "digest", "verify").agg(best("id").alias("id"), F.sum("group_size").alias("group_size"))
    return level.select("digest", "verify", F.col("id.doc_id").alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, keep: str = "max") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for every input row.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the largest doc_id stays
    (keep="min": the smallest). Repeated rows with the surviving doc_id are all marked kept. A group whose every doc_id is
    null has keep_id null and kept false, unless the group has a single row, which is kept. Empty input: no rows.
    """
    return _grouped(docs, keep).drop("raw")


def survivors(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The documents, with all their columns, that stay; rows with a null doc_id always do."""
    gone = _grouped(docs, keep).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone"), "raw")
    return without(docs, gone)


def _grouped(docs: DataFrame, keep: str) -> DataFrame:
    rows = written(digests(docs))
    groups = merge_runs(rows, keep).filter("group_size > 1").withColumnsRenamed({"digest": "g_digest", "verify": "g_verify"})
    joined = rows.join(groups, (F.col("digest") == F.col("g_digest")) & (F.col("verify") == F.col("g_verify")), "left")
    grouped = F.col("group_size").isNotNull()
    return joined.select(
        "doc_id",
        F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(grouped, F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))).otherwise(F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "raw",
    )

"""Sharding along a Hilbert curve over quantised metadata, in DataFrame operations only.

Size, language and source are quantised to four bits each, in an order-keeping way: a level is a range of values, so that
the least and largest value of a shard's files say what is in them. Sizes have a level per doubling; languages and sources
are cut into up to 16 ranges of equally many distinct values. The cell's place on the three-dimensional curve sorts the
rows, and equal runs of the sorted rows are the shards. Neighbours on the curve are near in every dimension, so shards
have narrow ranges in all three and prune on any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, ranked_rows

BITS, DIMS = 4, 3


def hilbert_cells(bits: int = BITS, dims: int = DIMS) -> list[int]:
    """Place on the curve by cell, cell = (x0 << 2*bits) | (x1 << bits) | x2.

    From each place its coordinates: Gray decoding of the transposed bits, then undoing exchanges and inversions from the
    finest level up (J. Skilling, Programming the Hilbert curve, 2004).
    """
    out = [0] * (1 << bits * dims)
    for place in range(len(out)):
        x = [sum((place >> (dims * b + dims - 1 - i) & 1) << b for b in range(bits)) for i in range(dims)]
        carry = x[-1] >> 1
        for i in range(dims - 1, 0, -1):
            x[i] ^= x[i - 1]
        x[0] ^= carry
        for level in range(1, bits):
            q = 1 << level
            for i in range(dims - 1, -1, -1):
                if x[i] & q:
                    x[0] ^= q - 1
                else:
                    swap = (x[0] ^ x[i]) & (q - 1)
                    x[0] ^= swap
                    x[i] ^= swap
        cell = 0
        for v in x:
            cell = cell << bits | v
        out[cell] = place
    return out


def cuts(docs: DataFrame, column: str, levels: int = 1 << BITS) -> list:
    """The least value of each level but the first: ranges of equally many of the distinct values (16 rows are collected)."""
    values = docs.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).select(column)
    level = F.expr(f"rank * {levels} div total")
    least = ranked_rows(values, [column]).groupBy(level.alias("level")).agg(F.min(column).alias("least"))
    return sorted(r["least"] for r in least.collect())[1:]


def leveled(column: str, cut: list) -> Column:
    """How many cuts a value reaches, spread over the levels; null: 0."""
    step = (1 << BITS) // (len(cut) + 1)
    reached = sum((F.coalesce((F.col(column) >= F.lit(c)).cast("int"), F.lit(0)) for c in cut), F.lit(0))
    return (reached * F.lit(step)).cast("int")


def shard_by_hilbert(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), hilbert.

    size is the text's UTF-8 bytes plus 1 (null text: 1, crc32 of the empty text). Shard row counts differ by one at most;
    with fewer rows than shards some stay empty. Rows with equal metadata are ordered by doc_id (null first), checksum and
    size; identical rows are interchangeable. No group is ever in one task: ranks come from a range sort and the counts of
    its partitions, whose number is what bounds the broadcast.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = pick(docs, "doc_id", "text", "lang", "source")
    level = F.least(F.lit(15), F.greatest(F.lit(0), F.floor(F.log2("size")).cast("int") - 4))
    cell = F.shiftleft(level, 2 * BITS) + F.shiftleft(leveled("lang", cuts(docs, "lang")), BITS) + leveled("source", cuts(docs, "source"))
    order = ["hilbert", "doc_id", "text_crc32", "size"]
    rows = (
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "lang", "source")
        .select("doc_id", "size", "text_crc32", F.get(F.lit(hilbert_cells()), cell).alias("hilbert"))
    )
    ranked = ranked_rows(rows, order).withColumn("shard", F.expr(f"int(rank * {shards} div total)"))
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.expr(f"rank - (shard * total + {shards - 1}) div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )

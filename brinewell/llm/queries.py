"""The queries opN_<name> of this subpackage: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontam, exact_dedup, langid, pii, sharding, simhash, suffix_dedup, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": lambda s, d: langid.identify(table(s, d, "documents")),
        "op2_personal_data": lambda s, d: pii.find_personal_data(table(s, d, "documents")).drop("row", "marks"),
        "op3_suffix_dedup": lambda s, d: suffix_dedup.remove_repeats(table(s, d, "documents")),
        "op4_decontamination": lambda s, d: decontam.leaks(table(s, d, "documents"), table(s, d, "benchmark")),
        "op5_exact_dedup": lambda s, d: exact_dedup.exact_dedup(table(s, d, "documents")),
        "op6_tool_calls": lambda s, d: chat.link_turns(table(s, d, "conversations")),
        "op7_simhash_dedup": lambda s, d: simhash.simhash_dedup(table(s, d, "documents")),
        "op8_warc": lambda s, d: warc.round_trip(table(s, d, "pages")),
        "op9_hilbert_sharding": lambda s, d: sharding.shard_by_hilbert(table(s, d, "documents")),
        "op10_bpe": lambda s, d: bpe.encode_documents(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_exact_dedup": f"""
            WITH d AS (SELECT doc_id, sha256({LOWER}) AS text_sha256 FROM documents)
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   doc_id = max(doc_id) OVER g AS kept, text_sha256
            FROM d WINDOW g AS (PARTITION BY text_sha256)""",
        "op8_warc": """
            WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
                 q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
            FROM q""",
    }

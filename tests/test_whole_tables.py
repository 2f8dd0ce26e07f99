"""Queries without SQL that work on all rows of their tables, against plain Python."""

import hashlib
import unicodedata
from collections import Counter

import duckdb
import regex

from brinewell.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


def read(sql):
    return duckdb.sql(sql.replace("{sf}", SF)).fetchall()


def test_every_user_turn_is_keyed(spark):
    want = Counter()
    for conv, turn, t in read("SELECT conv_id, turn, text FROM '{sf}/conversations.parquet' WHERE role = 'user'"):
        key = None
        if t is not None:
            folded = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.category(c).startswith("M")).lower()
            terms = {w[:64] for w in regex.findall(r"[\p{L}\p{N}]+", folded)[:16]}
            key = hashlib.sha256(("salt\0" + " ".join(sorted(terms))).encode()).hexdigest()
        want[conv, turn, key] += 1
    got = Counter((r["conv_id"], r["turn"], r["qkey"]) for r in QUERIES["query_key_all"](spark, SF).collect())
    assert got == want


def test_every_line_is_offered(spark):
    (n,) = read("SELECT count(*) FROM '{sf}/lineitem.parquet'")[0]
    got = QUERIES["admission_verdicts"](spark, SF).collect()
    assert len(got) == len({r["arrival"] for r in got}) == n


def test_every_document_is_tracked(spark):
    want = {}
    for doc, source, t in read("SELECT doc_id, source, coalesce(text, '') FROM '{sf}/documents.parquet'"):
        url, at = f"https://{source}.example.org/{doc}", 852_076_800_000 - doc * 3_600_000
        stored, arrived = doc % 3 != 0, doc % 2 == 0 or doc % 3 == 0
        same = doc % 5 != 0 or hashlib.sha256(url.encode()).hexdigest() == hashlib.sha256(t.encode()).hexdigest()
        changed = stored and arrived and not same
        want[hashlib.sha256(url.encode()).hexdigest()] = (at if stored else at + 1000, at if stored and not changed else at + 1000, int(changed))
    got = {r["url_key"]: (r["first_seen_at"], r["last_changed_at"], r["change_count"]) for r in QUERIES["change_tracking_all"](spark, SF).collect()}
    assert got == want


def test_offers_are_numbered_by_what_they_are_made_of(spark):
    from brinewell.plans.queries import offers

    plan = offers(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and not any("l_shipdate" in line or "l_tax" in line for line in windows)

"""The stored corpus: upserts with duplicate detection, removal, change tracking, and the link graph. Snapshots in, snapshots out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.shared import checkpointed

MAX_LINKS = 100


def canonical_key(canonical_url: Column, final_url: Column, own_key: Column) -> Column:
    """Key of an admissible canonical address that names another page, else null."""
    parsed = urls.normalize(canonical_url, final_url)
    key = urls.url_key(parsed["url"])
    return F.when(canonical_url.isNotNull() & parsed["url"].isNotNull() & (key != own_key), key)


def first_of_hash(documents: DataFrame) -> DataFrame:
    """documents with duplicate_of: of equal content the earliest page (then the least key) is the original;
    pages without a hash have none."""
    first = documents.groupBy(F.col("content_sha256").alias("c")).agg(F.min(F.struct("fetched_at", "url_key")).alias("first"))
    rows = documents.join(first, F.col("content_sha256") == F.col("c"), "left")
    return rows.withColumn("duplicate_of", F.when(F.col("first.url_key") != F.col("url_key"), F.col("first.url_key"))).drop("c", "first")


def change_tracking(stored: DataFrame, arrived: DataFrame) -> DataFrame:
    """Merge of stored and newly fetched pages, one row per key: first_seen_at, last_changed_at and change_count are carried on.

    arrived has one row per key. Content counts as changed where its hash differs from the stored one.
    """
    own = ["url", "title", "description", "canonical_key", "language", "text", "content_sha256", "fetched_at", "http_status", "host", "low_value"]
    own = [c for c in own if c in arrived.columns]
    s = stored.select(F.col("url_key").alias("s_key"), *[F.col(c).alias(f"s_{c}") for c in (*own, "first_seen_at", "last_changed_at", "change_count")])
    rows = s.join(arrived, F.col("s_key") == F.col("url_key"), "full")
    new, old = F.col("url_key").isNotNull(), F.col("s_key").isNotNull()
    changed = new & (~old | (F.col("content_sha256") != F.col("s_content_sha256")))
    return rows.select(
        F.coalesce("url_key", "s_key").alias("url_key"), *[F.when(new, F.col(c)).otherwise(F.col(f"s_{c}")).alias(c) for c in own], F.coalesce("s_first_seen_at", "fetched_at").alias("first_seen_at"),
        F.when(changed, F.col("fetched_at")).otherwise(F.coalesce("s_last_changed_at", "fetched_at", "s_fetched_at")).alias("last_changed_at"), (F.coalesce("s_change_count", F.lit(0)) + (changed & old).cast("int")).cast("long").alias("change_count"), F.coalesce(changed, F.lit(False)).alias("changed"),
    )


def _replay(pdf: pd.DataFrame) -> pd.DataFrame:
    """Upserts of a group of pages connected by content or canonical address, in order of arrival."""
    state: dict[str, dict] = {}
    out: dict[int, tuple] = {}

    def place(key: str, doc: dict, seen_before: bool) -> str | None:
        canonical = doc["canonical_key"]
        target = state.get(canonical) if canonical else None
        original = canonical if target and target["duplicate_of"] is None and target["canonical_key"] != key else None
        if original is None:
            same = [(d["fetched_at"], k) for k, d in state.items() if k != key and d["content_sha256"] == doc["content_sha256"] and d["duplicate_of"] is None]
            original = min(same)[1] if same else None
        previous = state.get(key)
        changed = previous is None or previous["content_sha256"] != doc["content_sha256"]
        state[key] = doc | {"duplicate_of": original}
        if changed and previous:
            copies = sorted((d["fetched_at"], k) for k, d in state.items() if d["duplicate_of"] == key and d["content_sha256"] != doc["content_sha256"] and d["canonical_key"] != key)
            for _, k in copies:
                place(k, {x: state[k][x] for x in ("content_sha256", "canonical_key", "fetched_at")}, True)
        if original is None:
            for k, d in state.items():
                if k != key and d["canonical_key"] == key and d["duplicate_of"] is None:
                    d["duplicate_of"] = key
        return original

    for r in pdf.sort_values(["fetched_at", "url_key"]).itertuples():
        place(r.url_key, {"content_sha256": r.content_sha256, "canonical_key": r.canonical_key if isinstance(r.canonical_key, str) else None, "fetched_at": int(r.fetched_at)}, False)
        out[r.Index] = ()
    return pd.DataFrame([(k, d["duplicate_of"]) for k, d in state.items()], columns=["url_key", "duplicate_of"])


def duplicates(documents: DataFrame) -> DataFrame:
    """url_key, duplicate_of for pages (url_key, content_sha256, canonical_key, fetched_at) upserted in order of arrival.

    Pages that only share content take one aggregation. Only where canonical addresses link pages is order a matter of more:
    those components, over content and canonical edges, are replayed one by one (a component is the pages of one site's
    variants; hash-only groups never go that way, however large).
    """
    docs = documents.select("url_key", "content_sha256", "canonical_key", "fetched_at")
    named = docs.filter("canonical_key is not null")
    touched = named.select("content_sha256").unionByName(docs.join(named.select(F.col("canonical_key").alias("k")).distinct(), F.col("url_key") == F.col("k"), "left_semi").select("content_sha256")).distinct()
    simple = first_of_hash(docs.join(touched, "content_sha256", "left_anti")).select("url_key", "duplicate_of")
    linked = docs.join(touched, "content_sha256", "left_semi")
    edges = linked.select(F.col("url_key").alias("a"), F.concat(F.lit("h:"), "content_sha256").alias("b")).unionByName(linked.filter("canonical_key is not null").select(F.col("url_key").alias("a"), F.col("canonical_key").alias("b")))
    replayed = linked.join(components(edges), F.col("url_key") == F.col("node")).groupBy("root").applyInPandas(lambda pdf: _replay(pdf), "url_key string, duplicate_of string")
    return simple.unionByName(replayed)


def components(edges: DataFrame) -> DataFrame:
    """node, root over edges (a, b): the least name spreads along edges, with pointer jumps, until nothing changes."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root"))
    while True:
        near = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("r"))
        new = label.join(near, F.col("node") == F.col("a")).select("node", F.least("root", "r").alias("root"))
        jump = new.select(F.col("node").alias("n"), F.col("root").alias("rr"))
        new = checkpointed(new.join(jump, F.col("root") == F.col("n")).select("node", F.least("root", "rr").alias("root")))
        old = label.select(F.col("node").alias("n"), F.col("root").alias("before"))
        if new.join(old, F.col("node") == F.col("n")).filter("root <> before").isEmpty():
            return new
        label = new


def removed(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents without keys (url_key); of the copies of a removed original, the earliest takes its place."""
    gone = keys.select(F.col("url_key").alias("g")).distinct()
    rest = documents.join(gone, F.col("url_key") == F.col("g"), "left_anti")
    orphans = rest.join(gone, F.col("duplicate_of") == F.col("g"), "left_semi")
    heir = orphans.groupBy(F.col("duplicate_of").alias("o")).agg(F.min(F.struct("fetched_at", "url_key")).alias("heir"))
    rows = rest.join(heir, F.col("duplicate_of") == F.col("o"), "left")
    target = F.when(F.col("heir.url_key") == F.col("url_key"), F.lit(None)).otherwise(F.col("heir.url_key"))
    return rows.withColumn("duplicate_of", F.when(F.col("o").isNotNull(), target).otherwise(F.col("duplicate_of"))).drop("o", "heir")


def counts(documents: DataFrame, links: DataFrame) -> DataFrame:
    """k, n: documents, duplicates, indexed, links."""
    d = documents.agg(F.count("*").alias("documents"), F.count("duplicate_of").alias("duplicates")).crossJoin(links.agg(F.count("*").alias("links")))
    parts = {"documents": F.col("documents"), "duplicates": F.col("duplicates"), "indexed": F.col("documents") - F.col("duplicates"), "links": F.col("links")}
    return d.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), c.alias("n")) for k, c in parts.items()])).alias("x")).select("x.*")


def replace_links(links: DataFrame, pages: DataFrame, new: DataFrame) -> DataFrame:
    """Links after pages (src_key) were fetched anew: new (src_key, seq, dst_key, dst_url, src_host, dst_host), a hundred each, not to themselves."""
    w = Window.partitionBy("src_key").orderBy("seq")
    first = new.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") <= MAX_LINKS) & (F.col("src_key") != F.col("dst_key")))
    first = first.withColumn("_d", F.row_number().over(Window.partitionBy("src_key", "dst_key").orderBy("seq"))).filter("_d = 1").select(*links.columns)
    return links.join(pages.select("src_key").distinct(), "src_key", "left_anti").unionByName(first)


def outlinks(links: DataFrame, src_key: str) -> DataFrame:
    return links.filter(F.col("src_key") == src_key).select("dst_key", "dst_url", "dst_host").orderBy("dst_url")


def page(documents: DataFrame, key: str) -> DataFrame:
    return documents.filter(F.col("url_key") == key)

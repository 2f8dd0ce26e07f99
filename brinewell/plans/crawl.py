"""A crawl cycle over snapshots: fetch results in, all tables out; and the loop that runs it over a catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domains as domain_functions
from ..functions import scoring, urls
from ..functions.scoring import Policy
from ..operators import corpus, frontier, search
from ..operators.ranks import ranked
from ..sources.catalog import Catalog
from ..sources.shared import checkpointed
from ..sources.schemas import TABLES, conform, valid_result

TABLES_USED = ("documents", "urls", "hosts", "domains", "links", "crawl_health")
OFFER = ("raw", "queue", "source", "depth", "external", "relevant", "priority_given")


def checked(leased: DataFrame, results: DataFrame) -> DataFrame:
    """Leased URLs with their results; what breaks the contract or doesn't fit its lease becomes INVALID_RESULT:reason."""
    flat = results.select(
        "idempotency_key", "requested_url", "final_url", F.col("outcome").alias("answered"), "http_status", F.col("content_sha256").alias("new_sha256"), F.col("etag").alias("new_etag"), F.col("last_modified").alias("new_modified"), "redirect_target", "retry_after_sec", "fetched_at_ms",
        F.col("robots.crawl_delay_sec").alias("crawl_delay_sec"), F.col("indexing").alias("indexing"), F.col("error.retryable").alias("retryable"), F.col("error.code").alias("error_code"), "page", valid_result().alias("valid"),
    ).dropDuplicates(["idempotency_key"])
    rows = leased.withColumn("key", urls.idempotency_key(F.col("url"), F.col("generation"))).join(flat, F.col("key") == F.col("idempotency_key"))
    facts = rows.withColumnsRenamed({"content_sha256": "old_sha256"}).withColumns({"outcome": F.col("answered"), "title": F.col("page.title"), "content_sha256": F.col("new_sha256")})
    facts = facts.withColumn("title", F.when(F.col("page").isNotNull(), F.coalesce("title", F.lit(""))))
    problem = F.when(~F.col("valid"), "SCHEMA").otherwise(frontier.cross_check())
    facts = facts.withColumn("problem", problem)
    return facts.withColumn("outcome", F.when(F.col("problem").isNotNull(), F.concat(F.lit("INVALID_RESULT:"), "problem")).otherwise(F.col("answered"))).drop("content_sha256", "title").withColumnRenamed("old_sha256", "content_sha256")


def _pages(rows: DataFrame) -> DataFrame:
    """Fetched pages that may be indexed, as documents to upsert."""
    p = F.col("page")
    links = F.coalesce(F.size(p["links"]), F.lit(0))
    text, title = F.coalesce(p["text"], F.lit("")), F.coalesce(p["title"], F.lit(""))
    final = F.coalesce("final_url", "url")
    return rows.filter("outcome = 'FETCHED' and source <> 'sitemap'").select(
        "url_key", "url", title.alias("title"), F.coalesce(p["description"], F.lit("")).alias("description"), corpus.canonical_key(p["canonical_url"], final, F.col("url_key")).alias("canonical_key"), p["language"].alias("language"), text.alias("text"), F.col("new_sha256").alias("content_sha256"),
        F.col("fetched_at_ms").alias("fetched_at"), "http_status", "host", (urls.soft_404(title, text, links) | urls.thin(text, links)).alias("low_value"), F.coalesce(F.col("indexing.noindex"), F.lit(False)).alias("noindex"), F.coalesce(F.col("indexing.nofollow"), F.lit(False)).alias("nofollow"), p["links"].alias("links"), "depth", "domain", "generation", p["canonical_url"].alias("canonical_url"), final.alias("final_url"),
    )


def apply_results(state: dict[str, DataFrame], results: DataFrame, now: int, policy: Policy = Policy(), families: dict | None = None, suffixes: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables after a batch of fetch results (FETCH_RESULT): the frontier's transitions, host and domain state, documents,
    links, and what the pages link to, admitted within budgets. Each result belongs to a lease of the same generation; any
    other changes nothing. An empty batch returns equal tables.
    """
    spark = results.sparkSession
    suffixes = suffixes if suffixes is not None else domain_functions.suffix_table(spark)
    u, docs, hosts, links = (state[t] for t in ("urls", "documents", "hosts", "links"))
    leased = u.filter("state = 'IN_FLIGHT'")
    failures = hosts.select(F.col("host").alias("fh"), "failures")
    to_leased = links.join(leased.select(F.col("url_key").alias("dst_key")), "dst_key", "left_semi")
    linkers = domain_functions.domains_of(to_leased.select(F.col("src_host").alias("host")).unionByName(to_leased.select(F.col("dst_host").alias("host"))), suffixes)
    referring = search.inbound_domains(to_leased, linkers).select(F.col("dst_key").alias("rk"), "inbound")
    found = checked(leased, results).join(failures, F.col("host") == F.col("fh"), "left").join(referring, F.col("url_key") == F.col("rk"), "left")
    every = checkpointed(found.withColumn("referring", F.coalesce("inbound", F.lit(0)).cast("long")).drop("rk", "inbound"))
    moved = frontier.transition(every.withColumn("outcome", F.when(F.col("problem").isNotNull(), "FETCH_FAILED").otherwise(F.col("outcome"))).withColumn("retryable", F.when(F.col("problem").isNotNull(), F.lit(True)).otherwise(F.col("retryable"))), now, policy)
    moved = checkpointed(moved.withColumn("outcome", F.when(F.col("problem").isNotNull(), F.concat(F.lit("INVALID_RESULT:"), "problem")).otherwise(F.col("outcome"))).withColumn("counts_as_error", F.col("counts_as_error") & F.col("problem").isNull()))
    after = checkpointed(frontier.applied(u, moved, now))

    pages = _pages(every)
    gone = every.filter("outcome = 'HTTP_ERROR' and http_status in (404, 410)").select("url_key").unionByName(pages.filter("noindex").select("url_key"))
    kept = conform(corpus.removed(docs, gone), "documents")
    arrived = pages.filter("not noindex").drop("noindex", "nofollow", "links", "depth", "domain", "generation", "canonical_url", "final_url")
    merged = corpus.change_tracking(kept, arrived)
    twins = corpus.duplicates(merged).select(F.col("url_key").alias("t"), "duplicate_of")
    merged = checkpointed(merged.join(twins, F.col("url_key") == F.col("t")).drop("t"))

    judged = pages.join(merged.select(F.col("url_key").alias("m"), F.col("duplicate_of").isNotNull().alias("dup")), F.col("url_key") == F.col("m"), "left").withColumn("kind", F.when(F.col("noindex"), "low_value").otherwise(frontier.page_kind(F.col("dup"), F.col("low_value"))))
    first = every.select(F.col("url_key").alias("f"), F.col("content_sha256").isNull().alias("first_page"))
    samples = judged.join(first, F.col("url_key") == F.col("f")).select("domain", F.lit(now).alias("ts"), "url_key", "kind", (F.col("first_page") | (F.col("kind") == "useful")).alias("affects_health")).unionByName(moved.filter("counts_as_error").select("domain", F.lit(now).alias("ts"), "url_key", F.lit("error").alias("kind"), F.lit(True).alias("affects_health")))
    samples = checkpointed(samples.withColumnRenamed("url_key", "seq"))

    names = checkpointed(domain_functions.domains_of(after.select("host").unionByName(links.select(F.col("dst_host").alias("host"))).unionByName(_link_hosts(pages, policy)), suffixes))
    foreign = ~urls.language_preferred(F.col("language"), policy.preferred_languages)
    out = checkpointed(frontier.page_links(judged.filter("not nofollow").select(F.col("url_key").alias("src_key"), "url", "host", "title", "links", foreign.alias("foreign_page")), names, policy))
    graph = out.join(judged.filter("kind <> 'duplicate' and not noindex").select(F.col("url_key").alias("j"), F.col("host").alias("src_host")), F.col("src_key") == F.col("j")).select("src_key", "seq", urls.url_key(F.col("url")).alias("dst_key"), F.col("url").alias("dst_url"), "src_host", "dst_host")
    replaced = corpus.replace_links(links, judged.filter("kind <> 'duplicate'").select(F.col("url_key").alias("src_key")).unionByName(gone.select(F.col("url_key").alias("src_key"))), graph)

    depth = judged.select(F.col("url_key").alias("s"), "depth", F.col("fetched_at").alias("at"))
    follow = frontier.choose_links(out, policy).join(out.select(F.col("src_key").alias("ks"), F.col("url").alias("ku"), "relevant").groupBy("ks", "ku").agg(F.max("relevant").alias("relevant")), (F.col("src_key") == F.col("ks")) & (F.col("url") == F.col("ku"))).join(depth, F.col("src_key") == F.col("s"))
    offers = follow.select(F.col("url").alias("raw"), F.lit("PUBLIC").alias("queue"), F.lit("discovered").alias("source"), (F.col("depth") + 1).alias("depth"), (F.col("kind") == "external").alias("external"), "relevant", F.concat_ws("#", "src_key", F.lpad("turn", 6, "0")).alias("order"), "at")
    redirects = every.filter("outcome = 'REDIRECT'").select(F.col("redirect_target").alias("raw"), "queue", F.lit("redirect").alias("source"), "depth", F.lit(False).alias("external"), F.lit(False).alias("relevant"), F.col("url_key").alias("order"), F.col("fetched_at_ms").alias("at"))
    sitemaps = frontier.sitemap_urls(every.filter("outcome = 'FETCHED' and source = 'sitemap'").select(F.col("url_key").alias("file_key"), "host", F.coalesce("page.text", F.lit("")).alias("body")), names, suffixes=suffixes)
    sitemaps = sitemaps.join(every.select(F.col("url_key").alias("fk"), F.col("fetched_at_ms").alias("at")), F.col("file_key") == F.col("fk"))
    listed = sitemaps.select(F.col("url").alias("raw"), F.lit("PUBLIC").alias("queue"), F.lit("sitemap").alias("source"), F.lit(1).cast("long").alias("depth"), F.lit(False).alias("external"), F.lit(False).alias("relevant"), F.concat_ws("#", "file_key", F.lpad("seq", 6, "0")).alias("order"), "at")
    arrivals = checkpointed(ranked(offers.unionByName(redirects).unionByName(listed), ["at", "order", "raw"], "arrival").withColumn("arrival", F.col("arrival").cast("long")))

    counters = after.groupBy("domain").agg(F.count_if(F.col("state") == "PENDING").alias("pending"))
    known = state["domains"].join(counters, "domain", "full").fillna({"pending": 0}).withColumn("family", F.coalesce("family", domain_functions.family_of(F.col("domain"), families)))
    admitted = checkpointed(frontier.admit(arrivals, after, known, state["crawl_health"], policy, suffixes, families).filter("verdict = 'ADDED'"))
    fresh = admitted.select("url_key", "url", "host", "domain", "queue", F.col("priority").cast("long").alias("priority"), F.lit("PENDING").alias("state"), F.lit(0).cast("long").alias("generation"), F.lit(0).cast("long").alias("attempts"), F.lit(now).alias("next_at"), "depth", F.lit(now).alias("discovered_at"), "source", "external")
    frontier_after = conform(after, "urls").unionByName(conform(fresh, "urls"))

    host_moves = moved.groupBy(F.col("host").alias("hm")).agg(F.max("host_next_allowed_at").alias("allowed"), F.max("host_backoff_until").alias("until"), F.max("resets_failures").alias("reset"), F.count("host_backoff_until").alias("failed"))
    hosts_after = hosts.join(host_moves, F.col("host") == F.col("hm"), "full").select(F.coalesce("host", "hm").alias("host"), F.greatest(F.coalesce("next_allowed_at", F.lit(0)), F.coalesce("allowed", F.lit(0))).alias("next_allowed_at"), F.greatest(F.coalesce("backoff_until", F.lit(0)), F.coalesce("until", F.lit(0))).alias("backoff_until"), (F.when(F.coalesce("reset", F.lit(False)), 0).otherwise(F.coalesce("failures", F.lit(0))) + F.coalesce("failed", F.lit(0))).alias("failures"))
    return {"documents": conform(merged, "documents"), "urls": frontier_after, "hosts": conform(hosts_after, "hosts"), "domains": _domains_after(state, frontier_after, samples, replaced, names, now, policy, families), "links": conform(replaced, "links"), "crawl_health": _health_after(state, samples, policy)}


def _link_hosts(pages: DataFrame, policy: Policy) -> DataFrame:
    rows = pages.select("url", F.explode("links").alias("l"))
    return rows.select(urls.normalize(F.col("l.url"), F.col("url"), policy.tracking_parameters)["host"].alias("host")).filter("host is not null")


def _domains_after(state, frontier_after, samples, links, names, now, policy, families) -> DataFrame:
    """Stored domain state after samples, with new domains behind those that wait."""
    old = state["domains"]
    new = frontier_after.filter("domain is not null").groupBy("domain").agg(F.max("priority").alias("priority"))
    waiting = frontier_after.filter("state = 'PENDING'").select("domain").distinct()
    start = frontier.first_vtime(old.join(waiting, "domain", "left_semi").withColumn("pending", F.lit(1)), new)
    start = start.join(old.select("domain"), "domain", "left_anti")
    blank = start.select("domain", domain_functions.family_of(F.col("domain"), families).alias("family"), F.lit(now).alias("first_seen"), F.col("vtime").cast("double").alias("vtime"))
    rows = conform(old, "domains").unionByName(conform(blank.withColumns({c: F.lit(0).cast("long") for c in ("leased", "fetched", "useful", "duplicates", "low_value", "errors", "yield_at", "ref_domains")}), "domains"))
    counts = samples.groupBy(F.col("domain").alias("c")).agg(F.count_if(F.col("kind") != "error").alias("n_fetched"), *[F.count_if(F.col("kind") == k).alias(f"n_{c}") for k, c in (("useful", "useful"), ("duplicate", "duplicates"), ("low_value", "low_value"), ("error", "errors"))])
    folded = frontier.fold_samples(samples, rows, state["crawl_health"], policy).select(F.col("domain").alias("y"), F.col("yield").alias("new_yield"), F.col("yield_at").alias("new_at"))
    refs = frontier.referring_domains(links, names).select(F.col("domain").alias("r"), F.col("ref_domains").alias("n_refs"))
    rows = rows.join(counts, F.col("domain") == F.col("c"), "left").join(folded, F.col("domain") == F.col("y"), "left").join(refs, F.col("domain") == F.col("r"), "left")
    more = {c: F.coalesce(c, F.lit(0)) + F.coalesce(f"n_{c}", F.lit(0)) for c in ("fetched", "useful", "duplicates", "low_value", "errors")}
    return conform(rows.withColumns(more | {"yield": F.coalesce("new_yield", "yield"), "yield_at": F.coalesce("new_at", "yield_at"), "ref_domains": F.greatest(F.coalesce("ref_domains", F.lit(0)), F.coalesce("n_refs", F.lit(0)))}), "domains")


def _health_after(state, samples, policy) -> DataFrame:
    old = state["crawl_health"]
    base = samples.select("domain").distinct().select("domain", F.lit(0.5).alias("yield"), F.lit(0).cast("long").alias("yield_at"))
    new = frontier.fold_samples(samples, base, old, policy).select("domain", "bad_streak", "cooldown_until")
    return conform(old.join(new.select("domain"), "domain", "left_anti").unionByName(new), "crawl_health")


def add_seeds(state: dict[str, DataFrame], seeds: DataFrame, now: int, policy: Policy = Policy(), families: dict | None = None) -> dict[str, DataFrame]:
    """urls and domains after seeds (url, host, seed_class): new ones are admitted, known ones are marked as seeds again."""
    from ..sources.inputs import seed_classes

    spark = seeds.sparkSession
    names = domain_functions.domains_of(seeds.select("host"), domain_functions.suffix_table(spark)).withColumnRenamed("host", "h")
    rows = seeds.join(names, F.col("host") == F.col("h")).withColumn("url_key", urls.url_key(F.col("url"))).dropDuplicates(["url_key"])
    known = frontier.promote(state["urls"], rows.select("url_key", F.lit("PUBLIC").alias("queue"), F.lit("seed").alias("source"), F.lit(scoring.SEED_PRIORITY).cast("long").alias("priority")), now, policy)
    new = rows.join(state["urls"].select("url_key"), "url_key", "left_anti").select("url_key", "url", "host", "domain", F.lit("PUBLIC").alias("queue"), F.lit(scoring.SEED_PRIORITY).cast("long").alias("priority"), F.lit("PENDING").alias("state"), F.lit(now).alias("next_at"), F.lit(0).cast("long").alias("depth"), F.lit(now).alias("discovered_at"), F.lit("seed").alias("source"))
    after = conform(known, "urls").unionByName(conform(new, "urls"))
    empty = state["links"].limit(0)
    none = spark.createDataFrame([], "domain string, ts long, seq string, kind string, affects_health boolean")
    names_all = names.withColumnRenamed("h", "host")
    domains = _domains_after(state, after, none, empty, names_all, now, policy, families)
    return state | {"urls": after, "domains": seed_classes(domains, rows.select("domain", "seed_class"))}


def run(spark: SparkSession, catalog: Catalog, fetch: Callable[[DataFrame], DataFrame], clock: Callable[[], int], rounds: int, slots: int = 8, policy: Policy = Policy(), families: dict | None = None) -> list[dict]:
    """Leases, fetches and applies `rounds` times; every round is two commits, so that a restart finds its leases and returns them.

    fetch turns leases into fetch results; it is the only thing that knows where pages come from.
    """
    catalog.commit({"urls": frontier.requeued(catalog.read("urls"))})
    out = []
    for turn in range(rounds):
        now = clock()
        state = {t: catalog.read(t) for t in TABLES_USED}
        view = _lease_view(state)
        leases = checkpointed(frontier.lease(state["urls"], state["hosts"], view, state["crawl_health"], now, slots, policy, turn * slots, families))
        domains = charged(state, view, leases, now, policy)
        catalog.commit({"urls": conform(frontier.claimed(state["urls"], leases, now), "urls"), "domains": conform(domains, "domains")})
        state = {t: catalog.read(t) for t in TABLES_USED}
        results = checkpointed(fetch(leases))
        catalog.commit(apply_results(state, results, clock(), policy, families))
        out.append({r["outcome"]: r["n"] for r in results.groupBy("outcome").agg(F.count("*").alias("n")).collect()})
    return out


def charged(state: dict[str, DataFrame], view: DataFrame, leases: DataFrame, now: int, policy: Policy = Policy()) -> DataFrame:
    """domains after leases: each counts, and each of a waiting public URL costs its domain a turn, 1 / weight of virtual time.

    A domain that sat idle starts at the front of the schedule, the least virtual time of those that wait."""
    fresh = leases.join(state["urls"].filter("state = 'PENDING' and queue = 'PUBLIC'").select("url_key"), "url_key", "left_semi")
    taken = leases.groupBy(F.col("domain").alias("d")).agg(F.count("*").alias("n"))
    turns = fresh.groupBy(F.col("domain").alias("t")).agg(F.count("*").alias("turns"))
    weight = scoring.domain_weight(F.col("done"), F.col("yield"), F.col("yield_at"), F.col("ref_domains"), F.lit(now), policy)["weight"]
    weights = view.select(F.col("domain").alias("w"), weight.alias("weight"))
    front = view.filter("pending > 0").agg(F.coalesce(F.min("vtime"), F.lit(0.0)).alias("front"))
    rows = state["domains"].join(taken, F.col("domain") == F.col("d"), "left").join(turns, F.col("domain") == F.col("t"), "left").join(weights, F.col("domain") == F.col("w"), "left").crossJoin(F.broadcast(front))
    moved = F.greatest(F.coalesce("vtime", F.lit(0.0)), F.col("front")) + F.col("turns") / F.col("weight")
    return rows.withColumn("leased", F.coalesce("leased", F.lit(0)) + F.coalesce("n", F.lit(0))).withColumn("vtime", F.when(F.col("turns").isNotNull(), moved).otherwise(F.col("vtime"))).drop("d", "n", "t", "turns", "w", "weight", "front")


def _lease_view(state: dict[str, DataFrame]) -> DataFrame:
    from ..operators.analytics import domain_counters

    return state["domains"].join(domain_counters(state["urls"]), "domain").fillna({"vtime": 0.0, "yield": 0.5, "yield_at": 0, "ref_domains": 0, "leased": 0})


def empty_state(spark: SparkSession) -> dict[str, DataFrame]:
    return {t: spark.createDataFrame([], TABLES[t]) for t in TABLES_USED}

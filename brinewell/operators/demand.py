"""Demand: which weak searches start a crawl, and which addresses they name."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import domains as domain_functions
from ..functions import scoring, urls
from ..functions.scoring import DAY, HOUR

#: Terms looked for in addresses, hits whose links count, links of each, template terms, names per domain.
TERMS_IN_URL, HITS, LINKS_PER_HIT, TEMPLATE_TERMS, PER_DOMAIN = 6, 5, 3, 8, 2


@dataclass(frozen=True)
class DemandPolicy:
    min_strong: int = 3
    cooldown_ms: int = 30 * 60_000
    max_cooldown_ms: int = 24 * HOUR
    max_candidates: int = 12
    max_pending: int = 300
    max_queries_per_hour: int = 30
    provider_per_hour: int = 20
    ledger_age_ms: int = 90 * DAY
    ledger_rows: int = 500_000


@dataclass(frozen=True)
class SearchContext:
    """What a source of candidates may look at."""

    frontier: DataFrame
    links: DataFrame
    terms: list[str]
    hits: DataFrame
    limit: int
    query: str = ""


#: A source names addresses in order: DataFrame (seq, raw).
Source = Callable[[SearchContext], DataFrame]


class DiscoveryProvider(Protocol):
    """An outside service that names addresses for a query, as JSON text."""

    name: str

    def discover(self, query: str, limit: int) -> str: ...


def seen(ledger: DataFrame, searches: DataFrame) -> DataFrame:
    """The ledger (qkey, first_seen, last_seen, times_seen, last_crawl_at, crawl_rounds, last_total, last_strong) after searches (qkey, ts, total, strong)."""
    new = searches.groupBy(F.col("qkey").alias("k")).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("*").alias("n"), F.max(F.struct("ts", "total", "strong")).alias("last"))
    rows = ledger.join(new, F.col("qkey") == F.col("k"), "full")
    return rows.select(F.coalesce("qkey", "k").alias("qkey"), F.coalesce("first_seen", "lo").alias("first_seen"), F.coalesce("hi", "last_seen").alias("last_seen"), (F.coalesce("times_seen", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("times_seen"), "last_crawl_at", F.coalesce("crawl_rounds", F.lit(0)).alias("crawl_rounds"), F.coalesce("last.total", "last_total").alias("last_total"), F.coalesce("last.strong", "last_strong").alias("last_strong"))


def demand_state(searches: DataFrame, ledger: DataFrame, pending: int, now: int, policy: DemandPolicy = DemandPolicy()) -> DataFrame:
    """searches (qkey, n_terms, strong) with state and retry_after_sec: none, cooldown, busy, rate_limited, or discover."""
    recent = ledger.agg(F.count_if(F.col("last_crawl_at") > now - HOUR).alias("recent"))
    old = ledger.select(F.col("qkey").alias("k"), "last_crawl_at", "crawl_rounds")
    rows = searches.join(old, F.col("qkey") == F.col("k"), "left").crossJoin(F.broadcast(recent))
    rest = scoring.demand_cooldown(F.coalesce("crawl_rounds", F.lit(0)), policy.cooldown_ms, policy.max_cooldown_ms)
    since = F.lit(now) - F.col("last_crawl_at")
    cooling = F.coalesce(since < rest, F.lit(False))
    state = F.when((F.col("n_terms") == 0) | (F.col("strong") >= policy.min_strong), "none").when(cooling, "cooldown").when(F.lit(pending >= policy.max_pending), "busy").when(F.col("recent") >= policy.max_queries_per_hour, "rate_limited").otherwise("discover")
    return rows.withColumn("state", state).withColumn("retry_after_sec", F.when(F.col("state") == "cooldown", F.ceil((rest - since) / 1000.0)).when(F.col("state") == "rate_limited", 60).cast("long")).select(*searches.columns, "state", "retry_after_sec")


def settle(ledger: DataFrame, results: DataFrame, now: int) -> DataFrame:
    """The ledger after discovery results (qkey, fresh, pending): a round counts only if it started something new."""
    r = results.select(F.col("qkey").alias("k"), "fresh")
    rows = ledger.join(r, F.col("qkey") == F.col("k"), "left")
    hit = F.col("k").isNotNull()
    return rows.withColumn("last_crawl_at", F.when(hit, F.lit(now)).otherwise(F.col("last_crawl_at"))).withColumn("crawl_rounds", F.col("crawl_rounds") + F.coalesce((F.col("fresh") > 0).cast("int"), F.lit(0))).drop("k", "fresh")


def outcome(fresh: Column, pending: Column) -> Column:
    """Struct (triggered, state, candidates) of a discovery."""
    return F.struct((fresh > 0).alias("triggered"), F.when(pending == 0, "no_candidates").otherwise("scheduled").alias("state"), pending.alias("candidates"))


def trimmed(ledger: DataFrame, now: int, policy: DemandPolicy = DemandPolicy()) -> DataFrame:
    """The ledger without queries not seen for long, and of the rest the most recently seen ones."""
    return ledger.filter(F.col("last_seen") >= now - policy.ledger_age_ms).orderBy(F.desc("last_seen"), "qkey").limit(policy.ledger_rows)


def ledger_stats(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count("*").alias("queries"), F.count_if(F.col("crawl_rounds") > 0).alias("explored"))


def url_source(context: SearchContext) -> DataFrame:
    """The address that the query itself is."""
    one = context.frontier.sparkSession.createDataFrame([(0, context.query)], "seq long, query string")
    q = F.trim("query")
    address = F.when(q.rlike("(?i)^https?://"), q).otherwise(F.concat(F.lit("https://"), q))
    return one.filter(urls.query_intent(F.col("query")) == "url").select("seq", urls.normalize(address)["url"].alias("raw"))


def frontier_source(context: SearchContext) -> DataFrame:
    """Waiting public addresses that name most of the terms."""
    words = [t for t in context.terms if len(t) >= 3][:TERMS_IN_URL]
    matches = sum((F.contains(F.lower("url"), F.lit(w)).cast("int") for w in words), F.lit(0))
    rows = context.frontier.filter("state = 'PENDING' and queue = 'PUBLIC'").withColumn("matches", matches).filter("matches > 0")
    best = rows.orderBy(F.desc("matches"), F.desc("priority"), "url").limit(context.limit)
    return best.select(F.row_number().over(Window.orderBy(F.desc("matches"), F.desc("priority"), "url")).cast("long").alias("seq"), F.col("url").alias("raw"))


def link_source(context: SearchContext, suffixes: DataFrame | None = None) -> DataFrame:
    """Of the five best hits (rank, url_key, host) three links each that were never fetched: to other domains first, then those that name a term."""
    spark = context.frontier.sparkSession
    hits = context.hits.orderBy("rank").limit(HITS).select(F.col("rank").alias("hit"), F.col("url_key").alias("hk"), F.col("host").alias("hh"))
    # A semi join passes below the distinct that a table of links may be made by, an inner join doesn't; and of the frontier only
    # what the hits link to is dealt out.
    links = context.links.join(F.broadcast(hits.select("hk")), F.col("src_key") == F.col("hk"), "left_semi")
    named_keys = links.select(F.col("dst_key").alias("nk")).distinct()
    known = context.frontier.select(F.col("url_key").alias("known")).join(F.broadcast(named_keys), F.col("known") == F.col("nk"), "left_semi")
    rows = links.join(F.broadcast(hits), F.col("src_key") == F.col("hk")).join(known, F.col("dst_key") == F.col("known"), "left_anti")
    names = domain_functions.domains_of(rows.select(F.col("dst_host").alias("host")).unionByName(rows.select(F.col("hh").alias("host"))), suffixes or domain_functions.suffix_table(spark))
    rows = rows.join(names.select(F.col("host").alias("h1"), F.col("domain").alias("there")), F.col("dst_host") == F.col("h1")).join(names.select(F.col("host").alias("h2"), F.col("domain").alias("home")), F.col("hh") == F.col("h2"))
    named = F.lit(False)
    for t in context.terms:
        named = named | F.contains(F.lower("dst_url"), F.lit(t))
    rows = rows.withColumns({"away": (F.col("there") != F.col("home")).cast("int"), "named": named.cast("int")})
    n = F.row_number().over(Window.partitionBy("hit").orderBy(F.desc("away"), F.desc("named"), "dst_url"))
    return rows.withColumn("n", n).filter(F.col("n") <= LINKS_PER_HIT).select((F.col("hit") * LINKS_PER_HIT + F.col("n")).cast("long").alias("seq"), F.col("dst_url").alias("raw"))


def expand_template(template: Column, terms: Column) -> Column:
    """A template with the first eight terms for {query} (a+b), {title} (A_b) and {slug} (a-b), percent-encoded."""
    few = F.slice(terms, 1, TEMPLATE_TERMS)
    joined = lambda words, sep: F.array_join(F.transform(words, lambda w: F.url_encode(w)), sep)
    title = F.transform(few, lambda w, i: F.when(i == 0, F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 64))).otherwise(w))
    out = F.replace(template, F.lit("{query}"), joined(few, "+"))
    out = F.replace(out, F.lit("{title}"), joined(title, "_"))
    return F.replace(out, F.lit("{slug}"), joined(few, "-"))


def template_source(templates: list[str]) -> Source:
    def source(context: SearchContext) -> DataFrame:
        rows = context.frontier.sparkSession.createDataFrame(list(enumerate(templates)), "seq long, template string")
        return rows.select("seq", expand_template(F.col("template"), F.array(*map(F.lit, context.terms)).cast("array<string>")).alias("raw"))

    return source


def first_per_domain(names: DataFrame, limit: int | None = None, per_domain: int = PER_DOMAIN, suffixes: DataFrame | None = None, partition: tuple[str, ...] = ()) -> DataFrame:
    """names (source, seq, raw) -> admissible addresses once, two of a domain, in order of source and seq, cut to limit.

    partition are further columns within which that holds, such as a query's key.
    """
    spark = names.sparkSession
    keys = list(partition)
    rows = names.withColumn("p", urls.normalize(F.col("raw"))).filter("p.url is not null").select(*keys, "source", "seq", F.col("p.url").alias("url"), F.col("p.host").alias("host"))
    once = rows.groupBy(*keys, "url", "host").agg(F.min(F.struct("source", "seq")).alias("at"))
    of = domain_functions.domains_of(once.select("host"), suffixes or domain_functions.suffix_table(spark))
    once = once.join(of.withColumnRenamed("host", "h"), F.col("host") == F.col("h")).drop("h")
    n = F.row_number().over(Window.partitionBy(*keys, "domain").orderBy("at"))
    few = once.withColumn("n", n).filter(F.col("n") <= per_domain)
    turn = F.row_number().over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy("at")) if keys or limit is None else None
    if turn is None:
        few = few.orderBy("at").limit(limit)
        turn = F.row_number().over(Window.orderBy("at"))
    out = few.withColumn("turn", turn)
    return (out.filter(F.col("turn") <= limit) if limit else out).select(*keys, "turn", "url", "domain")


def discover(sources: list[Source], context: SearchContext) -> DataFrame:
    """turn, url, domain: what the sources name, in their order."""
    names = None
    for i, source in enumerate(sources):
        part = source(context).select(F.lit(i).alias("source"), "seq", "raw")
        names = part if names is None else names.unionByName(part)
    return first_per_domain(names, context.limit)


def provider_names(answers: DataFrame) -> DataFrame:
    """answer, seq, raw of JSON answers (answer, body): {"results": [{"url"}]}, {"urls": [...]}, or a list of strings or such objects."""
    v = F.try_parse_json("body")
    is_list = F.schema_of_variant(v).startswith("ARRAY")
    items = F.when(is_list, F.try_variant_get(v, "$", "array<variant>")).otherwise(F.coalesce(F.try_variant_get(v, "$.results", "array<variant>"), F.try_variant_get(v, "$.urls", "array<variant>")))
    rows = answers.select("answer", F.posexplode(items).alias("seq", "item"))
    kind = F.schema_of_variant("item")
    raw = F.when(kind == "STRING", F.try_variant_get("item", "$", "string")).when(kind.startswith("OBJECT") & (F.schema_of_variant(F.try_variant_get("item", "$.url", "variant")) == "STRING"), F.try_variant_get("item", "$.url", "string"))
    return rows.select("answer", "seq", raw.alias("raw")).filter("raw is not null")


def pick_urls(answers: DataFrame, limit: int, suffixes: DataFrame | None = None) -> DataFrame:
    """answer, turn, url, domain: at most two addresses of a domain from each answer."""
    return first_per_domain(provider_names(answers).withColumn("source", F.lit(0)), limit, suffixes=suffixes, partition=("answer",))


def check_endpoint(endpoint: str) -> str:
    """A provider's endpoint: https, or http on this machine; no credentials, query or fragment."""
    from urllib.parse import urlsplit

    parts = urlsplit(endpoint)
    if not parts.scheme or not parts.netloc:
        raise ValueError("the provider endpoint is not a URL")
    if parts.username or parts.password:
        raise ValueError("the provider endpoint must not contain credentials")
    if parts.scheme != "https" and not (parts.scheme == "http" and parts.hostname in ("localhost", "127.0.0.1", "::1")):
        raise ValueError("the provider endpoint must be https (http only to this machine)")
    if parts.query or parts.fragment:
        raise ValueError("the provider endpoint must not carry a query or fragment")
    return endpoint


def provider_allowed(calls: list[int], now: int, policy: DemandPolicy = DemandPolicy()) -> bool:
    """Whether the provider may be asked once more within the hour."""
    return sum(now - t < HOUR for t in calls) < policy.provider_per_hour


def answer_frame(spark: SparkSession, provider: DiscoveryProvider, query: str, limit: int) -> DataFrame:
    """A provider's answer as a frame for pick_urls; one that isn't JSON names nothing."""
    body = provider.discover(query[:200], limit)
    try:
        json.loads(body)
    except ValueError:
        body = "[]"
    return spark.createDataFrame([(0, body)], "answer int, body string")

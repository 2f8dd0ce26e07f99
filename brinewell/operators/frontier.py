"""The crawl frontier: admission, leases, and what the answers change. Snapshots in, snapshots out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domains as domain_functions
from ..functions import scoring, text, urls
from ..functions.scoring import DAY, Policy
from ..sources.shared import checkpointed

#: Domains looked at per class, URLs per domain, rows per slot of a recrawl queue.
DOMAINS_PER_CLASS, URLS_PER_DOMAIN, OVERSCAN = 64, 8, 8
OUTCOMES = "FETCHED NOT_MODIFIED PROBED REDIRECT ROBOTS_DISALLOWED ROBOTS_UNAVAILABLE BLOCKED_TARGET RATE_LIMITED UNSUPPORTED_CONTENT_TYPE TOO_LARGE HTTP_ERROR FETCH_FAILED".split()
BUDGETS = ("HOST_BUDGET", "DOMAIN_BUDGET", "FAMILY_BUDGET", "GLOBAL_BUDGET")


def judged(links: DataFrame, frontier: DataFrame, policy: Policy = Policy(), suffixes: DataFrame | None = None, families: dict | None = None) -> DataFrame:
    """Offered addresses (arrival, raw, queue, source, depth, external, relevant) with what can be said of each on its own.

    verdict: a rejection, TOO_DEEP, EXISTS, LOW_VALUE, LANGUAGE_FILTERED, TRAP:*, REPEATED (an earlier offer of the same batch
    is WOULD_ADD), or WOULD_ADD. Budgets depend on what is admitted before and come with admit().
    """
    spark = links.sparkSession
    rows = links.withColumn("p", urls.normalize(F.col("raw"), extra_tracking=policy.tracking_parameters))
    rows = rows.select(*links.columns, F.col("p.url").alias("url"), F.col("p.host").alias("host"), F.col("p.reason").alias("reason")).withColumn("url_key", urls.url_key(F.col("url")))
    names = domain_functions.domains_of(rows.filter("host is not null").select("host"), suffixes or domain_functions.suffix_table(spark))
    # Rejected addresses have no host and no key: each gets one of its own to be joined by, which spreads them and matches nothing.
    own = F.concat(F.lit("~"), F.col("arrival").cast("string"))
    rows = rows.withColumns({"h_key": F.coalesce("host", own), "u_key": F.coalesce("url_key", own)})
    rows = rows.join(names.withColumnRenamed("host", "d_host"), F.col("h_key") == F.col("d_host"), "left").drop("d_host").withColumn("family", domain_functions.family_of(F.col("domain"), families))
    known = frontier.select(F.col("url_key").alias("k"), F.col("priority").alias("known_priority"))
    rows = rows.join(known, F.col("u_key") == F.col("k"), "left")
    hint_ok = urls.language_preferred(urls.language_hint(F.col("url")), policy.preferred_languages)
    judged_source = F.col("source").isin("discovered", "sitemap")
    rows = rows.withColumn("trap", urls.trap_reason(F.col("url")))
    trap = F.col("trap")
    verdict = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("depth") > policy.max_depth, "TOO_DEEP")
        .when(F.col("k").isNotNull(), "EXISTS")
        .when(judged_source & urls.low_value_reason(F.col("url")).isNotNull(), "LOW_VALUE")
        .when(judged_source & F.lit(policy.language_mode == "filter") & ~hint_ok, "LANGUAGE_FILTERED")
        .when(judged_source & trap.isNotNull(), F.concat(F.lit("TRAP:"), trap))
        .otherwise("WOULD_ADD")
    )
    priority = scoring.priority_breakdown(F.col("source"), F.col("depth"), F.col("external"), F.col("relevant"), hint_ok, F.contains(F.col("url"), F.lit("?")), policy)
    rows = rows.withColumn("verdict", verdict).withColumn("priority", priority["total"])
    first = F.min(F.when(F.col("verdict") == "WOULD_ADD", F.col("arrival"))).over(Window.partitionBy("u_key"))
    return rows.withColumn("verdict", F.when((F.col("verdict") == "WOULD_ADD") & (F.col("arrival") > first), "REPEATED").otherwise(F.col("verdict"))).drop("k", "reason", "trap", "h_key", "u_key")


def admit(links: DataFrame, frontier: DataFrame, domains: DataFrame, health: DataFrame, policy: Policy = Policy(), suffixes: DataFrame | None = None, families: dict | None = None) -> DataFrame:
    """judged() with budgets: a discovered URL is refused when its host, domain, family or the frontier is full by then.

    Host and domain budgets interact, so offers of a family are folded in order of arrival, a family in one task; only
    those of families that could run out of room take that path, all others pass by a count. The frontier's own budget is a
    cut-off in arrival order after that, as pending only grows within a batch.
    """
    rows = checkpointed(judged(links, frontier, policy, suffixes, families))  # addresses are parsed once
    open_ = rows.filter("verdict = 'WOULD_ADD'")
    by_host = frontier.groupBy("host").agg(F.count("*").alias("host_urls")).withColumnRenamed("host", "fh")
    by_domain = domains.select(F.col("domain").alias("fd"), F.col("pending").alias("domain_pending")).join(health.select(F.col("domain").alias("hd"), "bad_streak"), F.col("fd") == F.col("hd"), "left").drop("hd")
    by_family = domains.groupBy("family").agg(F.sum("pending").alias("family_pending")).withColumnRenamed("family", "ff")
    facts = open_.join(by_host, F.col("host") == F.col("fh"), "left").join(by_domain, F.col("domain") == F.col("fd"), "left").join(by_family, F.col("family") == F.col("ff"), "left").drop("fh", "fd", "ff")
    facts = facts.fillna({"host_urls": 0, "domain_pending": 0, "family_pending": 0, "bad_streak": 0})
    room = F.when(F.col("bad_streak") >= 8, F.least(F.lit(64), F.lit(policy.max_pending_per_domain))).otherwise(policy.max_pending_per_domain)
    facts = facts.withColumn("room", room)
    tight = facts.groupBy("family").agg(
        F.max("family_pending").alias("f0"), F.count("*").alias("f1"), F.max(F.col("domain_pending") - F.col("room")).alias("d0"), F.max("host_urls").alias("h0"), F.min("room").alias("least"),
    )
    full = (F.col("f0") + F.col("f1") > policy.max_pending_per_family) | (F.col("d0") + F.col("f1") > 0) | (F.col("h0") + F.col("f1") > policy.max_urls_per_host)
    tight = tight.filter(full).select(F.col("family").alias("tf"))
    loose = facts.join(tight, F.col("family") == F.col("tf"), "left_anti").select("arrival", F.lit("WOULD_ADD").alias("after"))
    folded = facts.join(tight, F.col("family") == F.col("tf"), "left_semi").select("arrival", "host", "domain", "family", "source", "host_urls", "domain_pending", "family_pending", "room")
    folded = folded.repartition("family").sortWithinPartitions("family", "arrival").mapInPandas(_budget_fold(policy), "arrival long, after string")
    passed = loose.unionByName(folded)
    start = frontier.filter("state = 'PENDING'").agg(F.count("*").alias("p0"))
    return _global_budget(rows, passed, start, policy)


def _budget_fold(policy: Policy):
    def fold(batches):
        """Offers sorted by family and arrival, a batch at a time: what is held are the counts of one family's hosts and domains."""
        hosts, domains, family, count = {}, {}, None, 0
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.family != family:
                    hosts, domains, family, count = {}, {}, r.family, int(r.family_pending)
                h, d = hosts.setdefault(r.host, int(r.host_urls)), domains.setdefault(r.domain, int(r.domain_pending))
                verdict = "WOULD_ADD"
                if r.source in ("discovered", "sitemap"):
                    if h >= policy.max_urls_per_host:
                        verdict = "HOST_BUDGET"
                    elif d >= r.room:
                        verdict = "DOMAIN_BUDGET"
                    elif r.family != r.domain and count >= policy.max_pending_per_family:
                        verdict = "FAMILY_BUDGET"
                if verdict == "WOULD_ADD":
                    hosts[r.host], domains[r.domain], count = h + 1, d + 1, count + 1
                out.append(verdict)
            yield pd.DataFrame({"arrival": pdf["arrival"].to_numpy(), "after": out})

    return fold


def _global_budget(rows: DataFrame, passed: DataFrame, start: DataFrame, policy: Policy) -> DataFrame:
    """Beyond the frontier's budget, counted in arrival order by ranges, discovered offers are refused."""
    counts = passed.filter("after = 'WOULD_ADD'").crossJoin(F.broadcast(start))
    room = start.select(F.greatest(F.lit(0), policy.max_pending_total - F.col("p0")).alias("room"))
    last = counts.select("arrival").orderBy("arrival").limit(policy.max_pending_total)  # never more rows than the budget itself
    full = last.agg(F.count("*").alias("n"), F.max("arrival").alias("last")).crossJoin(room).select(F.when(F.col("n") > F.col("room"), 1).otherwise(0).alias("over"), "room")
    ranked = last.crossJoin(F.broadcast(full.filter("over = 1"))).withColumn("r", F.row_number().over(Window.orderBy("arrival"))).filter(F.col("r") == F.col("room") + 1).select(F.col("arrival").alias("cut"))
    # Offers refused on their own pass straight through; only the others meet what the budgets say.
    alone = rows.filter("verdict <> 'WOULD_ADD'").withColumn("verdict", F.when(F.col("verdict") == "REPEATED", "EXISTS").otherwise(F.col("verdict")))
    joined = rows.filter("verdict = 'WOULD_ADD'").join(passed.withColumnRenamed("arrival", "a"), F.col("arrival") == F.col("a"), "left").join(F.broadcast(ranked), F.lit(True), "left")
    refused = (F.col("arrival") >= F.col("cut")) & (F.col("after") == "WOULD_ADD") & F.col("source").isin("discovered", "sitemap")
    verdict = F.when(F.coalesce(refused, F.lit(False)), "GLOBAL_BUDGET").when(F.col("after") == "WOULD_ADD", "ADDED").otherwise(F.col("after"))
    return alone.unionByName(joined.withColumn("verdict", verdict).drop("a", "after", "cut"))


def admission_counts(verdicts: DataFrame) -> DataFrame:
    """bucket, n: traps and rejected addresses are one bucket each."""
    own = ("ADDED", "EXISTS", "TOO_DEEP", *BUDGETS, "LOW_VALUE", "LANGUAGE_FILTERED")
    bucket = F.when(F.col("verdict").isin(*own), F.col("verdict")).when(F.col("verdict").startswith("TRAP:"), "TRAP").otherwise("REJECTED_URL")
    return verdicts.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def first_vtime(domains: DataFrame, new: DataFrame) -> DataFrame:
    """domain, vtime of new domains (domain, priority): behind those that wait, the better the priority the less."""
    low = domains.filter("pending > 0").agg(F.coalesce(F.floor(F.min("vtime")), F.lit(0)).alias("low"))
    return new.join(domains, "domain", "left_anti").crossJoin(F.broadcast(low)).select("domain", (F.col("low") + F.greatest(F.lit(0), 100 - F.col("priority")) / 1000.0).alias("vtime"))


def promote(frontier: DataFrame, offers: DataFrame, now: int, policy: Policy = Policy()) -> DataFrame:
    """The frontier after offers of known URLs (url_key, queue, source, priority): demand and seeds raise them, better priorities stay."""
    best = offers.groupBy(F.col("url_key").alias("k")).agg(F.max("priority").alias("p"), F.max(F.col("queue") == "DEMAND").alias("demand"), F.max((F.col("source") == "seed") & (F.col("queue") != "DEMAND")).alias("seed"))
    rows = frontier.join(best, F.col("url_key") == F.col("k"), "left")
    demand, seed = F.coalesce("demand", F.lit(False)), F.coalesce("seed", F.lit(False))
    waiting, done = F.col("state") == "PENDING", F.col("state") == "DONE"
    due = (demand & waiting & (F.col("attempts") == 0)) | (demand & done & (F.lit(now) - F.coalesce("fetched_at", F.lit(0)) >= policy.recrawl_min_ms))
    raised = F.col("k").isNotNull() & ((demand & waiting) | ~demand)
    return rows.withColumns({
        "source": F.when(demand & waiting, "demand").when(seed, "seed").otherwise(F.col("source")), "queue": F.when(demand & waiting, "DEMAND").otherwise(F.col("queue")),
        "priority": F.when(raised, F.greatest("priority", "p")).otherwise(F.col("priority")), "next_at": F.when(due, F.least("next_at", F.lit(now))).otherwise(F.col("next_at")),
    }).drop("k", "p", "demand", "seed")


def due(frontier: DataFrame, hosts: DataFrame, health: DataFrame, now: int) -> DataFrame:
    """URLs that may be leased now: their time has come, their host is free and rests no more, and their domain doesn't cool down
    (which holds back neither pending demand nor recrawls of pages once read)."""
    h = hosts.filter((F.col("next_allowed_at") > now) | (F.col("backoff_until") > now)).select("host")
    busy = frontier.filter("state = 'IN_FLIGHT'").select("host").distinct()
    cooling = health.filter(F.col("cooldown_until") > now).select(F.col("domain").alias("c"))
    rows = frontier.filter(F.col("next_at") <= now).join(h.unionByName(busy).distinct(), "host", "left_anti").join(cooling, F.col("domain") == F.col("c"), "left")
    exempt = ((F.col("state") == "PENDING") & (F.col("queue") == "DEMAND")) | ((F.col("state") == "DONE") & F.col("content_sha256").isNotNull())
    return rows.filter(F.col("c").isNull() | exempt).drop("c")


def ready_domains(frontier: DataFrame, hosts: DataFrame, domains: DataFrame, health: DataFrame, now: int, policy: Policy = Policy()) -> DataFrame:
    """Domains with room and a public pending URL that is due."""
    cooling = health.filter(F.col("cooldown_until") > now).select("domain")
    open_ = due(frontier, hosts, health, now).filter("state = 'PENDING' and queue = 'PUBLIC'").select("domain")
    return domains.filter((F.col("pending") > 0) & (F.col("in_flight") < policy.domain_concurrency)).join(cooling, "domain", "left_anti").join(open_, "domain", "left_semi")


def recrawl_spread(rows: DataFrame) -> DataFrame:
    """rows with turn: the first URL of every domain (in order of next_at, url_key) goes before any domain's second."""
    w = Window.partitionBy("domain").orderBy("next_at", "url_key")
    return rows.withColumn("turn", F.when(F.row_number().over(w) == 1, 0).otherwise(1))


def fair_picks(domains: DataFrame, now: int, n: int, policy: Policy = Policy()) -> DataFrame:
    """turn, domain: the first n leases of weighted fair queueing over domains with fixed weights.

    The k-th lease of a domain stands at vtime + (k-1)/weight; the n least of those are the picks, so that only n of
    each domain's are ever made, and of the domains only the n with the least virtual time.
    """
    weight = scoring.domain_weight(F.col("done"), F.col("yield"), F.col("yield_at"), F.col("ref_domains"), F.lit(now), policy)["weight"]
    first = domains.filter("pending > 0").orderBy("vtime", "domain").limit(n).withColumn("weight", weight)
    picks = first.select("domain", "vtime", "weight", F.explode(F.sequence(F.lit(1), F.least(F.lit(n).cast("long"), F.col("pending")))).alias("k"))
    return picks.select("domain", "k", (F.col("vtime") + (F.col("k") - 1) / F.col("weight")).alias("at")).orderBy("at", "domain", "k").limit(n)


def lease(frontier: DataFrame, hosts: DataFrame, domains: DataFrame, health: DataFrame, now: int, limit: int, policy: Policy = Policy(), turn: int = 0, families: dict | None = None) -> DataFrame:
    """turn, url_key, url, host, domain, queue, generation, depth, source, etag, last_modified: what to fetch next.

    Spark finds the few rows that can matter (the caps are those of each queue); taking turns over shared hosts, domains and
    families is sequential by nature and runs on those rows, some thousands at most, in one task.
    """
    open_ = due(frontier, hosts, health, now)
    cap = max(1, limit) * OVERSCAN
    cols = ["url_key", "url", "host", "domain", "state", "queue", "priority", "next_at", "generation", "depth", "source"] + [c for c in ("etag", "last_modified") if c in frontier.columns]
    none = [F.lit(None).cast("string").alias(c) for c in ("etag", "last_modified") if c not in frontier.columns]

    def part(rows: DataFrame, kind: str) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), *cols, *none)

    demand = open_.filter("state = 'PENDING' and queue = 'DEMAND'").orderBy(F.desc("priority"), "next_at", "url_key").limit(cap)
    done = open_.filter("state = 'DONE'").orderBy("next_at", "url_key").limit(cap)
    failed = open_.filter("state = 'FAILED'").orderBy("next_at", "url_key").limit(cap)
    ready = ready_domains(frontier, hosts, domains, health, now, policy)
    low = ready.orderBy("vtime", "domain").limit(max(DOMAINS_PER_CLASS, limit) * 2)
    young = ready.filter("leased < 5").orderBy("vtime", "domain").limit(max(DOMAINS_PER_CLASS, limit) * 2)
    span = domains.filter("pending > 0").agg(F.coalesce(F.min("vtime"), F.lit(0.0)).alias("vmin"), F.coalesce(F.max("vtime"), F.lit(0.0)).alias("vmax"))
    chosen = low.select("domain").unionByName(young.select("domain")).unionByName(_wildcards(ready, span, limit, policy, turn)).distinct()
    w = Window.partitionBy("domain").orderBy(F.desc("priority"), "next_at", "url_key")
    fresh = open_.filter("state = 'PENDING' and queue = 'PUBLIC'").join(chosen, "domain", "left_semi")
    fresh = fresh.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= URLS_PER_DOMAIN + limit)
    rows = part(demand, "demand").unionByName(part(done, "done")).unionByName(part(failed, "failed")).unionByName(part(fresh, "fresh"))
    weight = scoring.domain_weight(F.col("done"), F.col("yield"), F.col("yield_at"), F.col("ref_domains"), F.lit(now), policy)["weight"]
    streaks = health.select(F.col("domain").alias("s"), "bad_streak")
    family_load = domains.groupBy("family").agg(F.sum("in_flight").alias("family_in_flight")).withColumnRenamed("family", "g")
    facts = domains.join(streaks, F.col("domain") == F.col("s"), "left").join(family_load, F.col("family") == F.col("g")).select(F.col("domain").alias("d"), "family", "vtime", "leased", "in_flight", "family_in_flight", weight.alias("weight"), F.coalesce("bad_streak", F.lit(0)).alias("bad_streak"))
    rows = rows.join(facts, F.col("domain") == F.col("d"), "left").crossJoin(F.broadcast(span)).withColumn("one", F.lit(1))
    schema = "turn int, url_key string, url string, host string, domain string, queue string, generation long, depth long, source string, etag string, last_modified string"
    return rows.groupBy("one").applyInPandas(lambda pdf: _allocate(pdf, limit, policy, turn), schema)


def _slot_kind(slot: int, policy: Policy) -> str:
    number, e = slot * 37 % 100, policy.explore
    return "exploit" if number < e["exploit"] else "explore" if number < e["exploit"] + e["explore"] else "wildcard"


def _slot_share(slot: int) -> float:
    """Where a wildcard slot starts between the least and the greatest vtime, 0 to 1."""
    return slot * 0.6180339887498949 % 1


def _wildcards(ready: DataFrame, span: DataFrame, limit: int, policy: Policy, turn: int) -> DataFrame:
    """domain: for each wildcard slot that a lease of `limit` may come to, the first domains from its start on."""
    shares = [_slot_share(slot) for slot in range(turn, turn + max(0, limit)) if _slot_kind(slot, policy) == "wildcard"]
    out = ready.select("domain").limit(0)
    timed = ready.select("domain", "vtime").crossJoin(F.broadcast(span))
    for share in shares:
        start = F.col("vmin") + share * F.greatest(F.lit(0.0), F.col("vmax") - F.col("vmin"))
        out = out.unionByName(timed.filter(F.col("vtime") >= start).orderBy("vtime", "domain").limit(DOMAINS_PER_CLASS + limit).select("domain"))
    return out


def _allocate(pdf: pd.DataFrame, limit: int, policy: Policy, turn: int) -> pd.DataFrame:
    """Takes turns: demand, a share of recrawls, fresh URLs by weighted fair queueing with exploration, then more recrawls."""
    taken: list = []
    hosts: set[str] = set()
    load = {r.d: int(r.in_flight) for r in pdf.drop_duplicates("d").itertuples() if r.d == r.d and r.d is not None}
    family_load = {r.family: int(r.family_in_flight) for r in pdf.drop_duplicates("family").itertuples() if isinstance(r.family, str)}
    vtime = {r.d: float(r.vtime) for r in pdf.drop_duplicates("d").itertuples() if isinstance(r.d, str)}

    def room(r) -> bool:
        if not isinstance(r.d, str):
            return True
        if load[r.d] >= (1 if r.bad_streak >= 8 else policy.domain_concurrency):
            return False
        return r.family == r.d or family_load[r.family] < policy.family_concurrency

    def claim(r) -> None:
        hosts.add(r.host)
        taken.append(r)
        if isinstance(r.d, str):
            load[r.d] += 1
            family_load[r.family] += 1

    def take(rows, most: int, spread: bool = False) -> None:
        rows = list(rows.itertuples())
        if spread:
            seen: set = set()
            first, later = [], []
            for r in rows:
                (later if r.domain in seen else first).append(r)
                seen.add(r.domain)
            rows = first + later
        n = 0
        for r in rows:
            if n >= most or len(taken) >= limit:
                break
            if r.host not in hosts and room(r):
                claim(r)
                n += 1

    kind = lambda k, by, up: pdf[pdf["kind"] == k].sort_values(by, ascending=up, kind="stable")
    take(kind("demand", ["priority", "next_at", "url_key"], [False, True, True]), limit)
    rest = limit - len(taken)
    if rest > 0:
        again = pd.concat([kind("done", ["next_at", "url_key"], True).head(rest * OVERSCAN), kind("failed", ["next_at", "url_key"], True).head(rest * OVERSCAN)])
        take(again, -(-rest * int(policy.recrawl_share * 100) // 100) if rest >= 2 else int(turn % 4 == 3), True)
        fresh = {d: list(g.itertuples()) for d, g in kind("fresh", ["priority", "next_at", "url_key"], [False, True, True]).groupby("domain", sort=False)}
        facts = {d: g[0] for d, g in fresh.items()}
        vmin, vmax = (float(pdf[c].iloc[0]) for c in ("vmin", "vmax"))
        gone: set[str] = set()
        leased = {d: int(r.leased) for d, r in facts.items()}
        slot = turn
        while len(taken) < limit:
            first = _slot_kind(slot, policy)
            start = vmin + _slot_share(slot) * max(0.0, vmax - vmin)
            slot += 1
            pick = None
            for k in dict.fromkeys([first, "exploit"]):
                order = sorted((d for d in facts if (k != "explore" or leased[d] < 5) and (k != "wildcard" or vtime[d] >= start)), key=lambda d: (vtime[d], d))[:DOMAINS_PER_CLASS]
                for d in order:
                    if room(facts[d]) and (pick := next((r for r in fresh[d][: URLS_PER_DOMAIN + len(taken)] if r.host not in hosts and r.url_key not in gone), None)):
                        break
                if pick:
                    break
            if not pick:
                break
            gone.add(pick.url_key)
            vtime[pick.domain] = max(vtime[pick.domain], vmin) + 1 / float(pick.weight)
            leased[pick.domain] += 1
            claim(pick)
        take(again, limit - len(taken), True)
    out = [(i, r.url_key, r.url, r.host, r.domain, r.queue if r.state == "PENDING" else "PUBLIC", int(r.generation), int(r.depth), r.source, r.etag, r.last_modified) for i, r in enumerate(taken)]
    return pd.DataFrame(out, columns=["turn", "url_key", "url", "host", "domain", "queue", "generation", "depth", "source", "etag", "last_modified"])


def claimed(frontier: DataFrame, leases: DataFrame, now: int) -> DataFrame:
    """The frontier with leased URLs in flight; recrawls go to the public queue."""
    mine = leases.select(F.col("url_key").alias("k"))
    rows = frontier.join(F.broadcast(mine), F.col("url_key") == F.col("k"), "left")
    hit = F.col("k").isNotNull()
    return rows.withColumns({"queue": F.when(hit & (F.col("state") != "PENDING"), "PUBLIC").otherwise(F.col("queue")), "state": F.when(hit, "IN_FLIGHT").otherwise(F.col("state")), "leased_at": F.when(hit, F.lit(now)).otherwise(F.col("leased_at"))}).drop("k")


def requeued(frontier: DataFrame, now: int | None = None, policy: Policy = Policy()) -> DataFrame:
    """The frontier with leases returned: all of them, or the stale ones. No attempt is counted."""
    stale = (F.col("state") == "IN_FLIGHT") & (F.lit(True) if now is None else F.col("leased_at") <= now - policy.stale_lease_ms)
    return frontier.withColumns({"leased_at": F.when(stale, F.lit(None)).otherwise(F.col("leased_at")), "state": F.when(stale, "PENDING").otherwise(F.col("state"))})


def released(frontier: DataFrame, keys: DataFrame, now: int, delay_ms: int) -> DataFrame:
    """The frontier with some leases (url_key) given back for later, in the same generation."""
    rows = frontier.join(keys.select(F.col("url_key").alias("k")), F.col("url_key") == F.col("k"), "left")
    hit = F.col("k").isNotNull() & (F.col("state") == "IN_FLIGHT")
    return rows.withColumns({"next_at": F.when(hit, F.lit(now + delay_ms)).otherwise(F.col("next_at")), "leased_at": F.when(hit, F.lit(None)).otherwise(F.col("leased_at")), "state": F.when(hit, "PENDING").otherwise(F.col("state"))}).drop("k")


def cross_check() -> Column:
    """Why a fetch result (requested_url, final_url, outcome, ...) doesn't fit its lease (url, host), or null."""
    final = urls.normalize(F.col("final_url"))
    status = F.col("http_status")
    incomplete = F.col("title").isNull() | F.col("content_sha256").isNull() | status.isNull() | (status < 200) | (status > 299)
    return (
        F.when(~F.col("requested_url").eqNullSafe(F.col("url")), "REQUESTED_URL_MISMATCH")
        .when(F.col("final_url").isNotNull() & final["reason"].isNotNull(), "FINAL_URL_INVALID")
        .when(F.col("final_url").isNotNull() & (final["host"] != F.col("host")), "FINAL_URL_OFF_HOST")
        .when((F.col("outcome") == "REDIRECT") & F.col("redirect_target").isNull(), "REDIRECT_WITHOUT_TARGET")
        .when((F.col("outcome") == "FETCHED") & incomplete, "FETCHED_INCOMPLETE")
        .when((F.col("outcome") == "HTTP_ERROR") & (status.isNull() | (status < 400)), "HTTP_ERROR_STATUS")
        .when((F.col("outcome") == "RATE_LIMITED") & F.col("retry_after_sec").isNull(), "RATE_LIMITED_WITHOUT_DELAY")
        .when((F.col("outcome") == "FETCH_FAILED") & F.col("error_code").isNull(), "FAILED_WITHOUT_ERROR")
    )


def transition(rows: DataFrame, now: int, policy: Policy = Policy()) -> DataFrame:
    """rows (a frontier row with outcome, http_status, retry_after_sec, retryable, new_sha256, referring, failures,
    crawl_delay_sec) -> the URL's and its host's next state: new_state, new_next_at, new_attempts, new_interval_ms, changed,
    counts_as_error, host_next_allowed_at, host_backoff_until, resets_failures."""
    o, status = F.col("outcome"), F.coalesce("http_status", F.lit(0))
    retry_ms = F.col("retry_after_sec") * 1000
    changed = F.when(o == "NOT_MODIFIED", F.lit(False)).when((o == "FETCHED") & F.col("content_sha256").isNotNull() & F.col("new_sha256").isNotNull(), F.col("content_sha256") != F.col("new_sha256"))
    interval = F.when(o.isin("FETCHED", "NOT_MODIFIED"), scoring.next_interval(F.col("interval_ms"), changed, F.coalesce("referring", F.lit(0)), policy))
    attempts = F.col("attempts") + 1
    retry = (o == "ROBOTS_UNAVAILABLE") | ((o == "HTTP_ERROR") & ((status == 429) | (status >= 500))) | ((o == "FETCH_FAILED") & F.coalesce("retryable", F.lit(True)))
    wait = F.greatest(scoring.backoff(attempts, policy), F.when(o != "FETCH_FAILED", F.coalesce(retry_ms, F.lit(0))).otherwise(0))
    delay = F.greatest(F.lit(policy.host_delay_ms).cast("long"), F.coalesce(F.col("crawl_delay_sec") * 1000, F.lit(0)))
    limited = F.greatest(delay, F.coalesce(retry_ms, F.lit(0)))
    out_of_tries = retry & (attempts >= policy.max_attempts)
    state = (
        F.when(out_of_tries, "FAILED").when(retry, "PENDING").when(o.isin("ROBOTS_DISALLOWED", "RATE_LIMITED"), "PENDING").when(o == "BLOCKED_TARGET", "BLOCKED").when(o == "FETCH_FAILED", "FAILED").otherwise("DONE")
    )
    later = (
        F.when(out_of_tries, F.lit(policy.failed_recheck_ms)).when(retry, wait).when(interval.isNotNull(), interval).when(o == "PROBED", F.coalesce("interval_ms", F.lit(policy.recrawl_ms)))
        .when(o == "ROBOTS_DISALLOWED", F.lit(DAY)).when(o == "RATE_LIMITED", limited).when(o == "FETCH_FAILED", F.lit(policy.failed_recheck_ms))
        .when((o == "HTTP_ERROR") & ~status.isin(404, 410), F.lit(14 * DAY)).otherwise(F.lit(policy.gone_recheck_ms))
    )
    error = (o.isin("ROBOTS_UNAVAILABLE", "ROBOTS_DISALLOWED", "BLOCKED_TARGET", "FETCH_FAILED", "UNSUPPORTED_CONTENT_TYPE", "TOO_LARGE") | ((o == "HTTP_ERROR") & (status != 429))) & (F.col("source") != "sitemap")
    return rows.withColumns({
        "new_state": state, "new_next_at": (F.lit(now) + later).cast("long"), "new_attempts": F.when(retry, attempts).when(o == "RATE_LIMITED", F.col("attempts")).otherwise(0).cast("long"), "new_interval_ms": F.coalesce(interval, F.col("interval_ms")).cast("long"), "changed": changed,
        "counts_as_error": error, "host_next_allowed_at": (F.lit(now) + F.when(o == "RATE_LIMITED", limited).otherwise(delay)).cast("long"),
        "host_backoff_until": F.when(retry, F.lit(now) + F.greatest(wait, scoring.backoff(F.coalesce("failures", F.lit(0)) + 1, policy))).cast("long"), "resets_failures": o.isin("FETCHED", "NOT_MODIFIED"),
    })


def applied(frontier: DataFrame, transitions: DataFrame, now: int) -> DataFrame:
    """The frontier after transition() rows (one per url_key): a new generation, and what was learned."""
    t = transitions.select(F.col("url_key").alias("k"), "outcome", "http_status", "new_state", "new_next_at", "new_attempts", "new_interval_ms", F.col("new_sha256").alias("sha"))
    rows = frontier.join(t, F.col("url_key") == F.col("k"), "left")
    hit = F.col("k").isNotNull()
    to = lambda new, old: F.when(hit, new).otherwise(F.col(old))
    read = F.col("outcome").isin("FETCHED", "NOT_MODIFIED", "PROBED")
    return rows.withColumns({
        "next_at": to(F.col("new_next_at"), "next_at"), "attempts": to(F.col("new_attempts"), "attempts"), "generation": to(F.col("generation") + 1, "generation"), "last_outcome": to(F.col("outcome"), "last_outcome"), "last_http": to(F.col("http_status"), "last_http"),
        "leased_at": to(F.lit(None), "leased_at"), "queue": F.when(hit & (F.col("new_state") == "DONE"), "PUBLIC").otherwise(F.col("queue")), "fetched_at": F.when(hit & read, F.lit(now)).otherwise(F.col("fetched_at")),
        "content_sha256": F.when(hit & (F.col("outcome") == "FETCHED"), F.coalesce("sha", "content_sha256")).otherwise(F.col("content_sha256")), "interval_ms": to(F.col("new_interval_ms"), "interval_ms"), "state": to(F.col("new_state"), "state"),
    }).drop("k", "outcome", "http_status", "new_state", "new_next_at", "new_attempts", "new_interval_ms", "sha")


def page_kind(duplicate: Column, low_value: Column) -> Column:
    return F.when(duplicate, "duplicate").when(low_value, "low_value").otherwise("useful")


def fold_samples(samples: DataFrame, domains: DataFrame, health: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """domain, yield, yield_at, bad_streak, cooldown_until after page samples (domain, ts, seq, kind, affects_health) in order.

    A domain's samples are one ordered fold over its sorted array; a domain with very many should be fed in batches.
    """
    start = domains.select(F.col("domain").alias("d"), F.col("yield").alias("y0"), F.col("yield_at").alias("at0")).join(health.select(F.col("domain").alias("hd"), F.col("bad_streak").alias("s0"), F.col("cooldown_until").alias("c0")), F.col("d") == F.col("hd"), "left").drop("hd")
    lists = samples.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "kind", "affects_health"))).alias("xs")).join(start, F.col("domain") == F.col("d"))
    first = F.struct(F.col("y0").cast("double").alias("y"), F.col("at0").cast("long").alias("at"), F.coalesce("s0", F.lit(0)).cast("long").alias("streak"), F.coalesce("c0", F.lit(0)).cast("long").alias("until"))

    def step(acc: Column, x: Column) -> Column:
        useful = x["kind"] == "useful"
        y = scoring.effective_yield(acc["y"], acc["at"], x["ts"], policy) * 0.9 + F.when(useful, 0.1).otherwise(0.0)
        streak = F.when(x["affects_health"], F.when(useful, F.lit(0).cast("long")).otherwise(F.least(F.lit(32).cast("long"), acc["streak"] + 1))).otherwise(acc["streak"])
        until = F.when(x["affects_health"], scoring.domain_cooldown(streak, x["ts"], policy)).otherwise(acc["until"])
        return F.struct(F.least(F.lit(1.0), F.greatest(F.lit(0.0), y)).alias("y"), x["ts"].cast("long").alias("at"), streak.alias("streak"), until.cast("long").alias("until"))

    return lists.select("domain", F.aggregate("xs", first, step).alias("s")).select("domain", F.col("s.y").alias("yield"), F.col("s.at").alias("yield_at"), F.col("s.streak").alias("bad_streak"), F.col("s.until").alias("cooldown_until"))


def choose_links(links: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """src_key, url, kind, turn of the links to follow from each page (links: src_key, seq, url, domain, kind, relevant, foreign_page).

    A URL counts once; of external ones, one per domain first; internal ones that share words with the title first; a page
    in a foreign language only leads outside. Pages have at most a hundred links.
    """
    once = links.withColumn("_n", F.row_number().over(Window.partitionBy("src_key", "url").orderBy("seq"))).filter("_n = 1")
    of_domain = F.row_number().over(Window.partitionBy("src_key", "kind", "domain").orderBy("seq"))
    once = once.withColumn("_later", F.when(F.col("kind") == "external", (of_domain > 1).cast("int")).when(F.col("kind") == "internal", (~F.col("relevant")).cast("int")).otherwise(0))
    ranked = once.withColumn("turn", F.row_number().over(Window.partitionBy("src_key", "kind").orderBy("_later", "seq")))
    most = F.when(F.col("kind") == "external", policy.max_external_links).when(F.col("kind") == "internal", policy.max_internal_links).otherwise(policy.max_sibling_links)
    return ranked.filter((F.col("turn") <= most) & ((F.col("kind") == "external") | ~F.col("foreign_page"))).select("src_key", "url", "kind", "turn")


def page_links(pages: DataFrame, domains: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Links of fetched pages (src_key, url, host, title, links array of (url, nofollow)), resolved and classified for choose_links."""
    rows = pages.select("src_key", "url", "host", text.words(F.col("title")).alias("title_words"), F.coalesce("foreign_page", F.lit(False)).alias("foreign_page") if "foreign_page" in pages.columns else F.lit(False).alias("foreign_page"), F.posexplode("links").alias("seq", "link"))
    rows = rows.filter(~F.coalesce(F.col("link.nofollow"), F.lit(False))).withColumn("p", urls.normalize(F.col("link.url"), F.col("url"), policy.tracking_parameters)).filter("p.url is not null")
    src = domains.select(F.col("host").alias("sh"), F.col("domain").alias("src_domain"))
    dst = domains.select(F.col("host").alias("dh"), F.col("domain").alias("dst_domain"))
    rows = rows.join(src, F.col("host") == F.col("sh"), "left").join(dst, F.col("p.host") == F.col("dh"), "left")
    dst_domain = F.coalesce("dst_domain", "p.host")
    kind = F.when(dst_domain != F.coalesce("src_domain", "host"), "external").when(F.col("p.host") != F.col("host"), "sibling").otherwise("internal")
    return rows.select("src_key", "seq", F.col("p.url").alias("url"), F.col("p.host").alias("dst_host"), dst_domain.alias("domain"), kind.alias("kind"), text.path_shares(urls.path_of(F.col("p.url")), F.col("title_words")).alias("relevant"), "foreign_page")


def referring_domains(links: DataFrame, domains: DataFrame) -> DataFrame:
    """domain, ref_domains: how many other domains link to each."""
    src, dst = domains.select(F.col("host").alias("src_host"), F.col("domain").alias("src")), domains.select(F.col("host").alias("dst_host"), F.col("domain").alias("dst"))
    pairs = links.select("src_host", "dst_host").distinct().join(src, "src_host").join(dst, "dst_host").filter("src <> dst")
    return pairs.groupBy(F.col("dst").alias("domain")).agg(F.count_distinct("src").alias("ref_domains"))


def sitemap_urls(files: DataFrame, domains: DataFrame, most: int = 100, suffixes: DataFrame | None = None) -> DataFrame:
    """file_key, seq, url of sitemap texts (file_key, host, body): the first hundred addresses of the file's own domain."""
    lines = files.select("file_key", "host", F.posexplode(F.split("body", "\r?\n")).alias("seq", "line")).withColumn("line", F.trim("line")).filter(F.col("line").rlike("(?i)^https?://"))
    lines = lines.withColumn("p", urls.normalize(F.col("line"))).filter("p.url is not null")
    of = domains.select(F.col("host").alias("h"), F.col("domain").alias("d"))
    home = of.select(F.col("h").alias("h2"), F.col("d").alias("home"))
    own = lines.join(of, F.col("p.host") == F.col("h")).join(home, F.col("host") == F.col("h2")).filter("d = home")
    w = Window.partitionBy("file_key").orderBy("seq")
    return own.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).select("file_key", "seq", F.col("p.url").alias("url"))


def sitemap_probes(domains: DataFrame, frontier: DataFrame) -> DataFrame:
    """url of the sitemap of each host, once, of domains with three useful pages or more."""
    hosts = frontier.join(domains.filter("useful >= 3").select("domain"), "domain", "left_semi").select(F.regexp_extract("url", "^([a-z]+://[^/]+)", 1).alias("origin")).distinct()
    wanted = hosts.select(F.concat("origin", F.lit("/sitemap.txt")).alias("url"))
    return wanted.join(frontier.select("url"), "url", "left_anti")


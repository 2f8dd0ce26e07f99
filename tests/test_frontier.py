"""The sequential rules replayed in plain Python against the set-based operators."""

import random

import pytest
from pyspark.sql import functions as F

from brinewell.functions.domains import registrable_domain
from brinewell.functions.scoring import Policy
from brinewell.operators import corpus, demand, frontier

NOW = 1_000_000_000_000


def urls_frame(spark, rows):
    """rows of (key, host, domain, queue, state, priority, next_at, ...defaults)."""
    full = [(k, f"https://{h}/{k}", h, d, q, s, p, n, 0, 0, "discovered", None, 0, None, None) for k, h, d, q, s, p, n in rows]
    return spark.createDataFrame(full, "url_key string, url string, host string, domain string, queue string, state string, priority long, next_at long, attempts long, depth long, source string, leased_at long, generation long, content_sha256 string, fetched_at long")


def domains_frame(spark, names, **more):
    rows = [(d, d, more.get("pending", 5), 0, 0, 0.5, 0, 0, float(i), 0, 0) for i, d in enumerate(names)]
    return spark.createDataFrame(rows, "domain string, family string, pending long, in_flight long, done long, yield double, yield_at long, ref_domains long, vtime double, leased long, useful long")


def none(spark, schema):
    return spark.createDataFrame([], schema)


HOSTS, HEALTH = "host string, next_allowed_at long, backoff_until long, failures long", "domain string, bad_streak long, cooldown_until long"


def test_budgets_are_those_of_the_order_of_arrival(spark):
    r = random.Random(5)
    policy = Policy(max_pending_per_domain=6, max_pending_per_family=8, max_pending_total=32, max_urls_per_host=4)
    families = {"fam": ["a.example", "b.example"]}
    offers = [(i, f"https://h{r.randrange(3)}.{r.choice('abcd')}.example/{r.randrange(40)}", "PUBLIC", r.choice(["discovered", "discovered", "seed"]), r.randrange(10), False, False) for i in range(160)]
    known = urls_frame(spark, [(f"k{i}", f"h0.{'abcd'[i % 4]}.example", f"{'abcd'[i % 4]}.example", "PUBLIC", "PENDING", 10, 0) for i in range(8)])
    dom = spark.createDataFrame([(f"{c}.example", "fam" if c in "ab" else f"{c}.example", 2) for c in "abcd"], "domain string, family string, pending long")
    health = spark.createDataFrame([("d.example", 9, 0)], HEALTH)
    got = {x["arrival"]: x["verdict"] for x in frontier.admit(spark.createDataFrame(offers, "arrival long, raw string, queue string, source string, depth long, external boolean, relevant boolean"), known, dom, health, policy, families=families).collect()}
    hosts, pending, total, seen = {f"h0.{c}.example": 2 for c in "abcd"}, {f"{c}.example": 2 for c in "abcd"}, 8, set()
    for i, raw, _, source, depth, *_ in offers:
        host = raw.split("/")[2]
        d = registrable_domain(host)
        fam = "fam" if d in families["fam"] else d
        verdict = "ADDED"
        if depth > 8:
            verdict = "TOO_DEEP"
        elif raw in seen:
            verdict = "EXISTS"
        elif source == "discovered":
            if hosts.get(host, 0) >= 4:
                verdict = "HOST_BUDGET"
            elif pending[d] >= 6:
                verdict = "DOMAIN_BUDGET"
            elif fam != d and sum(pending[x] for x in families["fam"]) >= 8:
                verdict = "FAMILY_BUDGET"
            elif total >= 32:
                verdict = "GLOBAL_BUDGET"
        if verdict == "ADDED":
            seen.add(raw)
            hosts[host] = hosts.get(host, 0) + 1
            pending[d] += 1
            total += 1
        if got[i] != verdict:
            # An address refused before may be offered again: the batch judges its first offer only.
            assert got[i] == "EXISTS" and raw in [o[1] for o in offers[:i]], (i, raw, verdict, got[i])
    assert len(got) == len(offers) and {"ADDED", "HOST_BUDGET", "TOO_DEEP"} <= set(got.values())


def test_lease_takes_one_per_host_and_demand_first(spark):
    rows = [(f"d{i}", f"h{i}.a.example", "a.example", "DEMAND", "PENDING", 90 + i, 0) for i in range(3)] + [(f"p{i}", f"x{i % 4}.b{i % 5}.example", f"b{i % 5}.example", "PUBLIC", "PENDING", i, 0) for i in range(40)]
    rows += [("done", "z.c.example", "c.example", "PUBLIC", "DONE", 1, 0), ("later", "y.c.example", "c.example", "PUBLIC", "PENDING", 99, NOW + 1), ("fly", "x0.b0.example", "b0.example", "PUBLIC", "IN_FLIGHT", 1, 0)]
    u = urls_frame(spark, rows)
    dom = domains_frame(spark, ["a.example", "c.example", *[f"b{i}.example" for i in range(5)]])
    got = frontier.lease(u, none(spark, HOSTS), dom, none(spark, HEALTH), NOW, 8).orderBy("turn").collect()
    hosts = [x["host"] for x in got]
    assert len(set(hosts)) == len(hosts) == 8 and "x0.b0.example" not in hosts and "y.c.example" not in hosts
    assert [x["url_key"] for x in got[:2]] == ["d2", "d1"] and got[2]["url_key"] == "done" and "d0" not in [x["url_key"] for x in got]  # two at a time per domain
    after = frontier.claimed(u, frontier.lease(u, none(spark, HOSTS), dom, none(spark, HEALTH), NOW, 8), NOW)
    assert after.filter("state = 'IN_FLIGHT'").count() == 9
    assert frontier.requeued(after).filter("state = 'IN_FLIGHT'").count() == 0
    assert frontier.lease(u.limit(0), none(spark, HOSTS), dom, none(spark, HEALTH), NOW, 8).count() == 0


def test_fair_picks_equal_the_sequential_loop(spark):
    r = random.Random(9)
    rows = [(f"d{i}", f"d{i}", r.randrange(1, 6), 0, r.randrange(500), r.random(), NOW, r.randrange(9), r.random() * 3, 0, 0) for i in range(12)]
    dom = spark.createDataFrame(rows, "domain string, family string, pending long, in_flight long, done long, yield double, yield_at long, ref_domains long, vtime double, leased long, useful long")
    picks = [(x["domain"], x["k"]) for x in frontier.fair_picks(dom, NOW, 25).collect()]
    from brinewell.functions.scoring import domain_weight

    weight = {x["domain"]: x["w"] for x in dom.select("domain", domain_weight(F.col("done"), F.col("yield"), F.col("yield_at"), F.col("ref_domains"), F.lit(NOW))["weight"].alias("w")).collect()}
    v, left, want, turns = {x[0]: x[8] for x in rows}, {x[0]: x[2] for x in rows}, [], {}
    while len(want) < 25 and any(left.values()):
        d = min((d for d in v if left[d]), key=lambda d: (v[d], d))
        turns[d] = turns.get(d, 0) + 1
        want.append((d, turns[d]))
        v[d] += 1 / weight[d]
        left[d] -= 1
    assert sorted(picks) == sorted(want)


def test_cooldown_holds_back_neither_demand_nor_recrawls(spark):
    u = urls_frame(spark, [("a", "h1.x", "x", "PUBLIC", "PENDING", 1, 0), ("b", "h2.x", "x", "DEMAND", "PENDING", 1, 0), ("c", "h3.x", "x", "PUBLIC", "DONE", 1, 0), ("e", "h4.x", "x", "PUBLIC", "FAILED", 1, 0)]).withColumn("content_sha256", F.when(F.col("url_key") == "c", "s"))
    health = spark.createDataFrame([("x", 9, NOW + 5)], HEALTH)
    assert {r["url_key"] for r in frontier.due(u, none(spark, HOSTS), health, NOW).collect()} == {"b", "c"}


def test_links_to_follow(spark):
    policy = Policy(max_external_links=3, max_internal_links=2, max_sibling_links=1)
    rows = [("p", i, u, d, k, rel, False) for i, (u, d, k, rel) in enumerate([("e1", "x", "external", False), ("e2", "x", "external", False), ("e3", "y", "external", False), ("e1", "x", "external", False), ("e4", "x", "external", False), ("i1", "o", "internal", False), ("i2", "o", "internal", True), ("i3", "o", "internal", False), ("s1", "o", "sibling", False), ("s2", "o", "sibling", False)])]
    rows += [("f", i, u, d, k, False, True) for i, (u, d, k) in enumerate([("e9", "z", "external"), ("i9", "o", "internal")])]
    d = spark.createDataFrame(rows, "src_key string, seq int, url string, domain string, kind string, relevant boolean, foreign_page boolean")
    got = [(r["src_key"], r["url"]) for r in frontier.choose_links(d, policy).orderBy("src_key", "kind", "turn").collect()]
    assert got == [("f", "e9"), ("p", "e1"), ("p", "e3"), ("p", "e2"), ("p", "i2"), ("p", "i1"), ("p", "s1")]


def replay(pages):
    """Duplicate targets of pages upserted one by one."""
    state = {}
    for key, sha, canonical, at in sorted(pages, key=lambda p: (p[3], p[0])):
        t = state.get(canonical)
        original = canonical if t and t[2] is None and t[1] != key else None
        if original is None:
            original = min(((v[3], k) for k, v in state.items() if v[0] == sha and v[2] is None), default=(0, None))[1]
        state[key] = [sha, canonical, original, at]
        if original is None:
            for k, v in state.items():
                if k != key and v[1] == key and v[2] is None:
                    v[2] = key
    return {k: v[2] for k, v in state.items()}


@pytest.mark.parametrize("seed", range(3))
def test_duplicates_equal_upserts_in_order(spark, seed):
    r = random.Random(seed)
    pages = [(f"k{i}", f"s{r.randrange(12)}", f"k{r.randrange(30)}" if r.random() < 0.3 else None, r.randrange(1000)) for i in range(30)]
    pages = [(k, s, None if c == k else c, t) for k, s, c, t in pages] + [(f"h{i}", "many", None, i) for i in range(20)]
    d = spark.createDataFrame(pages, "url_key string, content_sha256 string, canonical_key string, fetched_at long")
    assert {x["url_key"]: x["duplicate_of"] for x in corpus.duplicates(d).collect()} == replay(pages)


def test_removal_promotes_the_earliest_copy(spark):
    d = spark.createDataFrame([("a", None, 1), ("b", "a", 3), ("c", "a", 2), ("d", None, 9)], "url_key string, duplicate_of string, fetched_at long")
    got = {x["url_key"]: x["duplicate_of"] for x in corpus.removed(d, spark.createDataFrame([("a",)], "url_key string")).collect()}
    assert got == {"c": None, "b": "c", "d": None}


def test_demand_rounds(spark):
    ledger = spark.createDataFrame([("q", NOW, NOW, 1, None, 0, 1, 1)], "qkey string, first_seen long, last_seen long, times_seen long, last_crawl_at long, crawl_rounds long, last_total long, last_strong long")
    ask = spark.createDataFrame([("q", 2, 0), ("new", 2, 0), ("ok", 2, 3), ("empty", 0, 0)], "qkey string, n_terms int, strong int")
    state = lambda led, now, pending=0: {r["qkey"]: r["state"] for r in demand.demand_state(ask, led, pending, now).collect()}
    assert state(ledger, NOW) == {"q": "discover", "new": "discover", "ok": "none", "empty": "none"}
    once = demand.settle(ledger, spark.createDataFrame([("q", 2)], "qkey string, fresh int"), NOW)
    assert state(once, NOW + 29 * 60_000)["q"] == "cooldown" and state(once, NOW + 30 * 60_000)["q"] == "discover"
    twice = demand.settle(once, spark.createDataFrame([("q", 1)], "qkey string, fresh int"), NOW)
    assert state(twice, NOW + 59 * 60_000)["q"] == "cooldown" and state(twice, NOW + 60 * 60_000, 300)["q"] == "busy"


def test_provider_endpoints():
    assert demand.check_endpoint("https://p.example/api") and demand.check_endpoint("http://127.0.0.1:8/x")
    for bad in ("nope", "http://p.example/", "https://u:p@p.example/", "https://p.example/?q", "https://p.example/#f"):
        with pytest.raises(ValueError):
            demand.check_endpoint(bad)
    assert not demand.provider_allowed([NOW - i for i in range(20)], NOW) and demand.provider_allowed([NOW - 3_600_000] * 20, NOW)


@pytest.mark.parametrize("limit", [1, 4])
def test_wildcard_slots_reach_all_ready_domains(spark, limit):
    names = [f"w{i:03}.example" for i in range(400)]
    u = urls_frame(spark, [(f"u{i}", f"h.{d}", d, "PUBLIC", "PENDING", 1, 0) for i, d in enumerate(names)])
    dom = domains_frame(spark, names).withColumn("leased", F.lit(9).cast("long"))
    turn = next(t for t in range(100) if t * 37 % 100 >= 90 and t * 0.6180339887498949 % 1 > 0.5)
    got = frontier.lease(u, none(spark, HOSTS), dom, none(spark, HEALTH), NOW, limit, turn=turn).orderBy("turn").collect()
    want, vtime = [], {d: float(i) for i, d in enumerate(names)}
    for slot in range(turn, turn + limit):
        start = slot * 0.6180339887498949 % 1 * 399 if slot * 37 % 100 >= 90 else 0.0
        want.append(next(d for d in names if vtime[d] >= start and d not in want))
    assert [r["domain"] for r in got] == want and int(want[0][1:4]) >= 200

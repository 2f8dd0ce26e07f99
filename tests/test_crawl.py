"""A small web crawled over snapshots."""

import hashlib

from pyspark.sql import functions as F

from brinewell.functions.scoring import Policy
from brinewell.plans import crawl
from brinewell.sources.catalog import Catalog
from brinewell.sources.schemas import FETCH_RESULT

NOW = 1_000_000_000_000
TEXT = "A page about gardens and what grows in them, long enough to be kept. "
WEB = {
    "https://a.example.com/": {"title": "Gardens", "text": TEXT + "one", "links": ["/gardens", "/two", "https://b.example.net/", "/pic.jpg", "https://c.example.org/moved"]},
    "https://a.example.com/gardens": {"title": "More", "text": TEXT + "two", "links": ["/"]},
    "https://a.example.com/two": {"title": "Copy", "text": TEXT + "one", "links": []},
    "https://b.example.net/": {"title": "B", "text": TEXT + "b", "links": [], "noindex": True},
    "https://c.example.org/moved": {"redirect": "https://c.example.org/here"},
    "https://c.example.org/here": {"status": 404},
}


def answers(spark):
    def fetch(leases):
        rows = []
        for r in leases.collect():
            w = WEB.get(r["url"], {"status": 404})
            key = f"crawl:{hashlib.sha256(r['url'].encode()).hexdigest()[:32]}:{r['generation']}"
            row = {"idempotency_key": key, "requested_url": r["url"], "final_url": r["url"], "fetched_at_ms": NOW, "robots": {"verdict": "ALLOWED"}}
            if "redirect" in w:
                row |= {"outcome": "REDIRECT", "http_status": 301, "redirect_target": w["redirect"]}
            elif "status" in w:
                row |= {"outcome": "HTTP_ERROR", "http_status": w["status"]}
            else:
                row |= {"outcome": "FETCHED", "http_status": 200, "content_sha256": hashlib.sha256(w["text"].encode()).hexdigest(), "indexing": {"noindex": w.get("noindex", False), "nofollow": False, "noarchive": False}, "page": {"title": w["title"], "text": w["text"], "language": "en", "links": [{"url": u, "nofollow": False} for u in w["links"]]}}
            rows.append(row)
        return spark.createDataFrame(rows, FETCH_RESULT)

    return fetch


def test_crawl(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    seeds = spark.createDataFrame([("https://a.example.com/", "a.example.com", "hub")], "url string, host string, seed_class string")
    c.commit(crawl.add_seeds(crawl.empty_state(spark), seeds, NOW))
    assert [tuple(r) for r in c.read("domains").select("domain", "seed_class", "vtime").collect()] == [("example.com", "hub", 0.04)]
    clock = iter(range(NOW, NOW + 10**9, 10_000)).__next__
    assert crawl.run(spark, c, answers(spark), clock, 1, 3, Policy(host_delay_ms=1000)) == [{"FETCHED": 1}]
    urls = {r["url"]: r for r in c.read("urls").collect()}
    assert set(urls) == {"https://a.example.com/", "https://a.example.com/gardens", "https://a.example.com/two", "https://b.example.net/", "https://c.example.org/moved"}  # the picture is refused
    assert urls["https://a.example.com/gardens"]["priority"] == 50 and urls["https://a.example.com/two"]["priority"] == 44  # the first shares a word with the title
    assert urls["https://b.example.net/"]["external"] and urls["https://b.example.net/"]["priority"] == 56
    first = urls["https://a.example.com/"]
    assert (first["state"], first["generation"], first["last_outcome"]) == ("DONE", 1, "FETCHED") and all(r["state"] == "PENDING" for u, r in urls.items() if u != first["url"])
    assert [r["url"] for r in c.read("documents").collect()] == ["https://a.example.com/"] and c.read("links").count() == 5
    d = {r["domain"]: r for r in c.read("domains").collect()}
    assert (d["example.com"]["useful"], d["example.com"]["leased"], d["example.net"]["ref_domains"]) == (1, 1, 1) and abs(d["example.com"]["yield"] - 0.55) < 1e-9


def test_results_that_do_not_fit(spark):
    row = ("k", "https://a.example.com/x", "https://a.example.com/x", "a.example.com", "example.com", "PUBLIC", 10, "IN_FLIGHT", 0)
    u = spark.createDataFrame([row], "url_key string, url string, u2 string, host string, domain string, queue string, priority long, state string, generation long").drop("u2")
    state = crawl.empty_state(spark) | {"urls": crawl.conform(u.withColumns({"next_at": F.lit(0).cast("long"), "depth": F.lit(0).cast("long"), "source": F.lit("discovered")}), "urls")}
    key = f"crawl:{hashlib.sha256(row[1].encode()).hexdigest()[:32]}:0"
    bad = spark.createDataFrame([{"idempotency_key": key, "requested_url": row[1], "final_url": "https://evil.example.net/", "outcome": "PROBED", "fetched_at_ms": NOW}], FETCH_RESULT)
    got = crawl.apply_results(state, bad, NOW)["urls"].first()
    assert got["last_outcome"] == "INVALID_RESULT:FINAL_URL_OFF_HOST" and got["state"] == "PENDING" and got["attempts"] == 1 and got["generation"] == 1

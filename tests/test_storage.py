"""Snapshots, inputs, configuration, streams and reports."""

import json

import pytest
from pyspark.sql import functions as F

from brinewell import cli
from brinewell.operators import analytics, demand, frontier, reports, search
from brinewell.plans import sample
from brinewell.sources import config, inputs, schemas
from brinewell.sources.catalog import Catalog, backup, fingerprint
from brinewell.streaming import outcomes

SF = "/root/testdata/sf0.001"


def test_catalog_commits_together_and_migrates(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    assert c.read("urls").count() == 0 and c.current() == {}
    old = sample.frame(spark, SF, "urls").drop("source", "external", "domain")
    c.commit({"urls": old, "links": sample.frame(spark, SF, "links")})
    got = c.read("urls")
    assert got.schema.simpleString() == schemas.TABLES["urls"].simpleString() and got.count() == old.count()
    assert {r["source"] for r in got.select("source").distinct().collect()} <= {"demand", "seed", "discovered"}
    first = c.current()["urls"]
    with pytest.raises(Exception):  # noqa: B017
        c.commit({"urls": got.select(F.raise_error(F.lit("no")).alias("x"))})
    assert c.current()["urls"] == first
    assert c.commit({"urls": got.limit(5)}) == 2 and c.read("urls").count() == 5 and c.read("links").count() > 0
    copies = backup(c, str(tmp_path / "b"))
    assert copies["urls"] == fingerprint(c.read("urls"))
    with pytest.raises(Exception):  # noqa: B017
        backup(c, str(tmp_path / "b"))


def test_seeds_and_replays(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("# seeds\nhttps://a.example/ class=news # first\n\nftp://x\nb\nhttps://b.example/x\n")
    got = {(r["url"], r["seed_class"]) for r in inputs.read_seeds(spark, str(tmp_path / "seeds.txt")).collect()}
    assert got == {("https://a.example/", "news"), ("https://b.example/x", None)}
    inputs.register(spark)
    df = spark.read.format("replay").option("answers", json.dumps({"https://a/": "FETCHED", "https://b/": {"outcome": "HTTP_ERROR", "http_status": 500}})).load()
    assert {(r["requested_url"], r["outcome"], r["http_status"]) for r in df.collect()} == {("https://a/", "FETCHED", 200), ("https://b/", "HTTP_ERROR", 500)}
    lines = [{"idempotency_key": "k", "requested_url": "u", "outcome": "FETCHED", "fetched_at_ms": 1, "page": {"text": "x" * n, "links": []}} for n in (5, 11_000)] + [{"outcome": "NO", "requested_url": "u", "fetched_at_ms": 1}]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, lines)))
    results = inputs.read_results(spark, str(tmp_path / "r.json"))
    assert sorted(r[0] for r in results.select(schemas.valid_result()).collect()) == [False, False, True] and inputs.once(results).count() == 2


def test_configuration():
    env = {"BRINEWELL_ROOT": "/x", "BRINEWELL_MAX_DEPTH": "5", "BRINEWELL_LANGUAGES": "en, DE", "BRINEWELL_MIN_STRONG": "2", "BRINEWELL_DOMAIN_FAMILIES": "w=a.org,b.org"}
    c = config.from_environment(env)
    assert c.policy.max_depth == 5 and c.policy.preferred_languages == ("en", "de") and c.demand.min_strong == 2 and c.families == {"w": ["a.org", "b.org"]}
    for name, value in (("ROOT", ""), ("MAX_DEPTH", "99"), ("MAX_DEPTH", "x"), ("DOMAIN_FAMILIES", "secret"), ("PROVIDER", "http://secret.example/")):
        with pytest.raises(ValueError) as e:
            config.from_environment(env | {f"BRINEWELL_{name}": value})
        assert "secret" not in str(e.value)


def drained(query, spark, name):
    query.processAllAvailable()
    query.stop()
    return spark.sql(f"select * from {name}")


def test_streams(spark, tmp_path):
    src = sample.frame(spark, SF, "outcomes").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("idempotency_key", F.concat(F.lit("k"), (F.col("event_id") % 700).cast("string")))
    src.limit(900).write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(stored.schema).parquet(str(tmp_path / "in"))
    hours = drained(outcomes.hourly(read()).writeStream.outputMode("complete").format("memory").queryName("hours").start(), spark, "hours")
    want = analytics.hourly(stored)
    assert hours.agg(F.sum("answers"), F.sum("fetched")).first() == want.agg(F.sum("answers"), F.sum("fetched")).first() and hours.count() == want.count()
    once = drained(outcomes.once(read()).writeStream.outputMode("append").format("memory").queryName("once_").start(), spark, "once_")
    assert once.count() == stored.select("idempotency_key").distinct().count()
    samples = stored.select("domain", F.unix_millis("ts").alias("ts_ms"), F.col("event_id").alias("seq"), F.when(F.col("outcome") == "FETCHED", "useful").otherwise("error").alias("kind"), F.lit(True).alias("affects_health"))
    samples.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(samples.schema).parquet(str(tmp_path / "s"))
    got = {r["domain"]: r for r in drained(outcomes.yields(stream).writeStream.outputMode("update").format("memory").queryName("yields").start(), spark, "yields").collect()}
    base = samples.select("domain").distinct().select("domain", F.lit(0.5).alias("yield"), F.lit(0).cast("long").alias("yield_at"))
    health = spark.createDataFrame([], "domain string, bad_streak long, cooldown_until long")
    for r in frontier.fold_samples(samples.withColumnRenamed("ts_ms", "ts"), base, health).collect():
        g = got[r["domain"]]
        assert abs(g["yield"] - r["yield"]) < 1e-9 and (g["bad_streak"], g["cooldown_until"]) == (r["bad_streak"], r["cooldown_until"])


def test_results_update_the_catalog_once(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    u = sample.frame(spark, SF, "urls")
    c.commit({"urls": u})
    some = u.filter("state = 'PENDING'").orderBy("url_key").limit(20)
    res = some.select("url_key", "generation", F.lit("NOT_MODIFIED").alias("outcome"), F.lit(304).alias("http_status"), F.lit(None).cast("long").alias("retry_after_sec"), F.lit(None).cast("boolean").alias("retryable"), F.lit(None).cast("string").alias("new_sha256"), F.lit(0).cast("long").alias("referring"), F.lit(0).cast("long").alias("failures"), F.lit(None).cast("long").alias("crawl_delay_sec"))
    res.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(res.schema).parquet(str(tmp_path / "in"))
    outcomes.maintain(stream(), c, lambda: sample.NOW, str(tmp_path / "w1")).awaitTermination()
    after = c.read("urls")
    keys = {r["url_key"] for r in some.collect()}
    assert {r["url_key"] for r in after.filter("last_outcome = 'NOT_MODIFIED'").collect()} == keys
    outcomes.maintain(stream(), c, lambda: sample.NOW + 5, str(tmp_path / "w2")).awaitTermination()  # the same answers again
    assert fingerprint(c.read("urls")) == fingerprint(after)


def test_reports(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    u = sample.frame(spark, SF, "urls")
    c.commit({"urls": u, "hosts": sample.frame(spark, SF, "hosts"), "domains": sample.frame(spark, SF, "domains")})
    for command in ("analyze", "concentration", "health", "prune", "seeds"):
        sections = cli.run(command, c, None, sample.NOW)
        assert json.loads(reports.as_json(sections)).keys() == sections.keys() and reports.as_text(sections)
    url = u.filter("state = 'PENDING'").first()["url"]
    assert cli.run("explain", c, url, sample.NOW)["explain"].count() == 1
    assert cli.run("domain", c, "d7.example", sample.NOW)["outcomes"].count() > 0
    before = c.read("urls").count()
    cli.run("prune-apply", c, None, sample.NOW)
    assert c.read("urls").count() < before


def test_incremental_index(spark):
    p = sample.frame(spark, SF, "pages_in")
    whole = search.build_index(p)
    part = search.build_index(p.filter("doc_id % 3 <> 0"))
    same = search.replace_in_index(part, p.filter("doc_id % 3 = 0 or doc_id % 5 = 0"), p.limit(0).select(F.col("url_key").alias("doc_key")))
    assert fingerprint(same.postings.select("term", "doc_key", "weighted", "n")) == fingerprint(whole.postings.select("term", "doc_key", "weighted", "n"))
    gone = search.replace_in_index(whole, p.limit(0), p.filter("doc_id < 50").select(F.col("url_key").alias("doc_key")))
    assert gone.documents.count() == whole.documents.count() - p.filter("doc_id < 50").count()


def test_indexing_bounds_arrow_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, 256 << 20)
        search.build_index(sample.frame(spark, SF, "pages_in"))
        assert int(spark.conf.get(key).rstrip("b")) <= 8 << 20
    finally:
        spark.conf.set(key, before)


def test_link_source_drops_links_of_other_pages_before_they_are_made_distinct(spark):
    hits = spark.createDataFrame([(1, "p1", "h1.d1.example")], "rank int, url_key string, host string")
    context = demand.SearchContext(sample.frame(spark, SF, "urls"), sample.frame(spark, SF, "links"), ["example"], hits, 40)
    plan = demand.link_source(context)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    scans = [i for i, line in enumerate(plan) if "Relation" in line and "l_suppkey" in line]
    assert scans
    for i in scans:
        above, at = [], depth(plan[i])
        for line in reversed(plan[:i]):
            if depth(line) < at:
                above.append(line)
                at = depth(line)
        first = next(n for n, line in enumerate(above) if "Aggregate" in line)
        assert any("LeftSemi" in line for line in above[:first])

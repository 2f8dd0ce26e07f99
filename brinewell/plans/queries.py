"""Queries over the sample tables, one or more for each operator, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring, text, urls
from ..functions.scoring import Policy, rounded
from ..operators import analytics, corpus, demand, frontier, search
from . import sample
from .sample import NOW, ctes, frame

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
QUERY_TERMS = "the thing of"
SMALL = Policy(max_pending_per_domain=60, max_pending_per_family=200, max_pending_total=3000)


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def long(c: Column) -> Column:
    return c.cast("long")


def host_domains(rows: DataFrame, *hosts: str) -> DataFrame:
    """host, domain of sample hosts, whose domain is all but the first label."""
    out = None
    for h in hosts:
        part = rows.select(F.col(h).alias("host"))
        out = part if out is None else out.unionByName(part)
    return out.distinct().select("host", F.regexp_replace("host", r"^[^.]*\.", "").alias("domain"))


ROUND = "floor({} * 1000.0 + 0.5) / 1000.0"
R4 = "floor(({}) * 10000.0 + 0.5) / 10000.0"

# ---- text and scalar functions ----


@query("query_terms", "SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')[1:16], lambda t: t[1:64]), ' ') AS terms FROM conversations WHERE role = 'user'")
def _(s, d):
    return frame(s, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.array_join(text.query_terms(F.col("text")), " ").alias("terms"))


@query("query_key", "SELECT conv_id, turn, sha256('salt' || chr(0) || array_to_string(list_sort(list_distinct(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')[1:16])), ' ')) AS qkey FROM conversations WHERE role = 'user' AND text NOT LIKE '%ß%'")
def _(s, d):
    rows = frame(s, d, "conversations").filter("role = 'user' and text not like '%ß%'")
    folded = F.transform(text.query_terms(search.fold_ascii_or_accents(F.col("text"))), lambda t: t)
    return rows.select("conv_id", "turn", text.query_key(F.lit("salt"), folded).alias("qkey"))


@query("query_key_all", None)
def _(s, d):
    """Every user turn, with the operator's own fold; the SQL of query_key leaves out texts with a sharp s."""
    rows = frame(s, d, "conversations").filter("role = 'user'")
    return rows.select("conv_id", "turn", text.query_key(F.lit("salt"), text.query_terms(text.fold(F.col("text")))).alias("qkey"))


@query("url_key", f"{ctes('pages_in')} SELECT doc_id, url_key, 'crawl:' || url_key[1:32] || ':3' AS idempotency FROM pages_in")
def _(s, d):
    p = frame(s, d, "pages_in")
    return p.select("doc_id", urls.url_key(F.col("url")).alias("url_key"), urls.idempotency_key(F.col("url"), F.lit(3)).alias("idempotency"))


@query("folded_tokens", "SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{L}\\p{N}]+'))) AS BIGINT) AS n_tokens FROM documents")
def _(s, d):
    return frame(s, d, "documents").select("doc_id", long(F.size(text.tokens(text.fold(F.coalesce("text", F.lit("")))))).alias("n_tokens"))


@query("normalize_url", None)
def _(s, d):
    p = frame(s, d, "pages")
    return p.select("page_id", urls.normalize(F.col("url")).alias("p")).select("page_id", "p.url", "p.host", "p.origin", "p.reason")


PAGE_URL = "regexp_replace(url, '#.*$', '')"
PATH = f"regexp_extract({PAGE_URL}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
QUERY_STRING = f"regexp_extract({PAGE_URL}, '^[^?#]*\\?(.*)$', 1)"


def page_urls(s, d) -> DataFrame:
    return frame(s, d, "pages").select("page_id", F.regexp_replace("url", "#.*$", "").alias("url"))


@query("tracking_strip", f"SELECT page_id, coalesce(array_to_string(list_filter(string_split({QUERY_STRING}, '&'), lambda p: NOT regexp_full_match(string_split(p, '=')[1], 'utm_[a-z0-9_]+|fbclid|gclid|dclid|msclkid|mc_eid|mc_cid|igshid|yclid|_hsenc|_hsmi', 'i')), '&'), '') AS kept FROM pages")
def _(s, d):
    return page_urls(s, d).select("page_id", urls.strip_tracking(F.regexp_extract("url", r"^[^?#]*\?(.*)$", 1)).alias("kept"))


@query("variant_key", f"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_extract({PAGE_URL}, '^([^?]*)', 1), '^[a-z]+://', ''), '^www\\.', ''), '/+$', '') || regexp_extract({PAGE_URL}, '^[^?]*(\\?.*)$', 1) AS variant FROM pages")
def _(s, d):
    return page_urls(s, d).select("page_id", urls.variant_key(F.col("url")).alias("variant"))


def listed(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


@query(
    "language_hint",
    f"""WITH p AS (SELECT page_id, string_split({HOST}, '.') AS labels, lower(coalesce(string_split({PATH}, '/')[2], '')) AS seg FROM pages)
        SELECT page_id, CASE WHEN len(labels) >= 3 AND ((labels[1] IN ({listed(urls.HOST_CODES)}) AND labels[1] NOT IN ({listed(urls.HOST_AMBIGUOUS)})) OR (regexp_full_match(labels[1], '[a-z]{{2}}-[a-z]{{2,}}') AND string_split(labels[1], '-')[1] IN ({listed(urls.HOST_CODES)})))
                             THEN CASE WHEN string_split(labels[1], '-')[1] = 'simple' THEN 'en' ELSE string_split(labels[1], '-')[1] END
                             WHEN regexp_full_match(seg, '[a-z]{{2}}([-_][a-z]{{2}})?') AND seg[1:2] IN ({listed(urls.HOST_CODES)}) AND seg[1:2] NOT IN ({listed(urls.PATH_AMBIGUOUS)}) THEN seg[1:2] END AS hint FROM p""",
)
def _(s, d):
    return page_urls(s, d).select("page_id", urls.language_hint(F.col("url")).alias("hint"))


@query("low_value_url", f"""SELECT page_id, CASE WHEN regexp_matches({PATH}, '{urls.BINARY_EXTENSION}') THEN 'NON_HTML_FILE'
        WHEN len(list_filter(string_split({QUERY_STRING}, '&'), lambda p: p <> '' AND regexp_matches(string_split(p, '=')[1], '{urls.NOISE_PARAMETER}'))) > 0 THEN 'NOISE_PARAM' WHEN regexp_matches({PATH}, '{urls.NOISE_PATH}') THEN 'NOISE_PATH' END AS reason FROM pages""")
def _(s, d):
    return page_urls(s, d).select("page_id", urls.low_value_reason(F.col("url")).alias("reason"))


@query(
    "crawl_trap",
    f"""WITH o AS (SELECT o_orderkey, 'https://h.example.org' || CASE o_orderkey % 9 WHEN 0 THEN '/a/b/a/c/a' WHEN 1 THEN '/archive/1999/12' WHEN 2 THEN '/list/page/' || (o_orderkey % 50) WHEN 3 THEN '/x?sort=asc' WHEN 4 THEN '/x?page=' || (o_orderkey % 40) WHEN 5 THEN '/x?a=1&b=1&c=1' WHEN 6 THEN '/x?year=1999&month=2' WHEN 7 THEN '/x;jsessionid=1' ELSE '/plain/' || o_orderkey END AS url FROM orders),
        p AS (SELECT *, list_filter(string_split(regexp_extract(url, '^https://[^/]*([^?]*)', 1), '/'), lambda x: x <> '') AS seg, list_filter(string_split(regexp_extract(url, '\\?(.*)$', 1), '&'), lambda x: x <> '') AS par FROM o)
        SELECT o_orderkey, CASE WHEN list_contains(list_transform(seg, lambda x: len(list_filter(seg, lambda y: y = x)) >= 3), true) THEN 'REPEATING_SEGMENTS' WHEN url LIKE '%;jsessionid=%' THEN 'PATH_SESSION'
               WHEN len(par) >= 3 AND len(list_distinct(list_transform(par, lambda x: string_split(x, '=')[2]))) = 1 THEN 'REPEATED_PARAM_VALUE' WHEN len(par) > 0 AND par[1] LIKE 'sort=%' THEN 'SESSION_OR_FILTER_PARAM'
               WHEN list_contains(seg, 'archive') AND len(list_filter(seg, lambda x: regexp_full_match(x, '[0-9]{{4}}|[0-9]{{1,2}}'))) >= 2 THEN 'CALENDAR' WHEN url LIKE '%year=%month=%' THEN 'CALENDAR'
               WHEN len(par) > 0 AND par[1] LIKE 'page=%' AND CAST(string_split(par[1], '=')[2] AS INT) > 20 THEN 'DEEP_PAGINATION' WHEN len(seg) >= 3 AND seg[2] = 'page' AND CAST(seg[3] AS INT) > 20 THEN 'DEEP_PAGINATION' END AS trap FROM p""",
)
def _(s, d):
    k, t = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    forms = ["/a/b/a/c/a", "/archive/1999/12", F.concat(F.lit("/list/page/"), (k % 50).cast("string")), "/x?sort=asc", F.concat(F.lit("/x?page="), (k % 40).cast("string")), "/x?a=1&b=1&c=1", "/x?year=1999&month=2", "/x;jsessionid=1"]
    path = F.concat(F.lit("/plain/"), t)
    for i, form in enumerate(forms):
        path = F.when(k % 9 == i, F.lit(form) if isinstance(form, str) else form).otherwise(path)
    return frame(s, d, "orders").select("o_orderkey", urls.trap_reason(F.concat(F.lit("https://h.example.org"), path)).alias("trap"))


@query("soft_404_thin", f"SELECT doc_id, length(coalesce(text, '')) <= 600 AND regexp_matches(substr(coalesce(text, ''), 1, 300), '{urls.SOFT_404.replace(chr(39), chr(39) * 2)}') AS soft_404, length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) < 40 AS thin FROM documents")
def _(s, d):
    t, none = F.coalesce("text", F.lit("")), F.lit(0)
    return frame(s, d, "documents").select("doc_id", urls.soft_404(F.lit(""), t, none).alias("soft_404"), urls.thin(t, none).alias("thin"))


@query("registrable_domain", f"SELECT page_id, regexp_extract({HOST}, '([^.]+\\.(example|com|net|org|io))$', 1) AS domain FROM pages WHERE regexp_matches({HOST}, '\\.(example|com|net|org|io)$')")
def _(s, d):
    from ..functions.domains import domains_of, suffix_table

    p = page_urls(s, d).select("page_id", urls.host_of(F.col("url")).alias("host")).filter(F.col("host").rlike(r"\.(example|com|net|org|io)$"))
    names = domains_of(p, suffix_table(s)).withColumnRenamed("host", "h")
    return p.join(names, F.col("host") == F.col("h")).select("page_id", "domain")


@query("snippet", None)
def _(s, d):
    return frame(s, d, "documents").select("doc_id", text.snippet(F.coalesce("text", F.lit("")), F.lit(""), F.array(F.lit("the"), F.lit("und"))).alias("snippet"))


@query("plain_excerpt", None)
def _(s, d):
    return frame(s, d, "documents").select("doc_id", text.excerpt(F.coalesce("text", F.lit("")), F.array(F.lit("thing"))).alias("excerpt"))


@query("priority_of", f"""{ctes('urls')} SELECT url_key, CAST(CASE source WHEN 'seed' THEN 60 ELSE greatest(0, least(99, greatest(0, 50 - 6 * depth) + CASE WHEN external THEN 12 ELSE 0 END + CASE WHEN priority % 2 = 0 THEN 6 ELSE 0 END - CASE WHEN priority % 5 = 0 THEN 20 ELSE 0 END - CASE WHEN priority % 3 = 0 THEN 6 ELSE 0 END)) END AS BIGINT) AS total FROM urls""")
def _(s, d):
    p = F.col("priority")
    b = scoring.priority_breakdown(F.col("source"), F.col("depth"), F.col("external"), p % 2 == 0, p % 5 != 0, p % 3 == 0)
    return frame(s, d, "urls").select("url_key", b["total"].alias("total"))


WEIGHT = """greatest(0.0125, greatest(0.05, 1.0 / (1.0 + done / 200.0)) * (0.25 + 1.5 * (0.5 + (yield - 0.5) * pow(0.5, greatest(0, 852076800000 - yield_at) / 604800000.0))) * (1.0 + 0.1 * least(4.0, log2(1.0 + ref_domains))))"""


@query("domain_weight", f"{ctes('domains')} SELECT domain, round({WEIGHT}, 6) AS weight FROM domains")
def _(s, d):
    w = scoring.domain_weight(F.col("done"), F.col("yield"), F.col("yield_at"), F.col("ref_domains"), F.lit(NOW))
    return frame(s, d, "domains").select("domain", F.round(w["weight"], 6).alias("weight"))


@query("backoff", f"{ctes('urls')} SELECT url_key, CAST(least(21600000, 60000 * pow(2, greatest(0, priority % 12 - 1))) AS BIGINT) AS wait, CASE WHEN priority % 12 < 8 THEN 0 ELSE 852076800000 + CAST(least(21600000, 60000 * pow(2, priority % 12 - 8)) AS BIGINT) END AS rests_until, CAST(least(86400000, 1800000 * pow(2, least(16, greatest(0, depth - 1)))) AS BIGINT) AS demand_rest FROM urls")
def _(s, d):
    n = F.col("priority") % 12
    return frame(s, d, "urls").select("url_key", scoring.backoff(n).alias("wait"), scoring.domain_cooldown(n, F.lit(NOW)).alias("rests_until"), scoring.demand_cooldown(F.col("depth")).alias("demand_rest"))


@query("recrawl_interval", f"""{ctes('urls')} SELECT url_key, CAST(CASE WHEN depth % 3 = 0 THEN coalesce(interval_ms, 604800000) WHEN depth % 3 = 1 THEN greatest(21600000, floor(coalesce(interval_ms, 604800000) / 2.0 + 0.5)) ELSE least(CASE WHEN priority % 8 >= 5 THEN 1209600000 ELSE 5184000000 END, coalesce(interval_ms, 604800000) * 2) END AS BIGINT) AS next_interval FROM urls""")
def _(s, d):
    changed = F.when(F.col("depth") % 3 == 0, F.lit(None)).otherwise(F.col("depth") % 3 == 1)
    return frame(s, d, "urls").select("url_key", scoring.next_interval(F.col("interval_ms"), changed, F.col("priority") % 8).alias("next_interval"))


@query("slot_classes", f"{ctes('urls')} SELECT url_key, CASE WHEN (priority * 37) % 100 < 70 THEN 'exploit' WHEN (priority * 37) % 100 < 90 THEN 'explore' ELSE 'wildcard' END AS class FROM urls")
def _(s, d):
    return frame(s, d, "urls").select("url_key", scoring.slot_class(F.col("priority")).alias("class"))


@query("template_expand", "SELECT conv_id, turn, 'https://w.example.org/' || array_to_string(w, '+') || '/' || upper(w[1][1:1]) || substr(array_to_string(w, '_'), 2) || '/' || array_to_string(w, '-') AS url FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+')[1:8] AS w FROM conversations WHERE role = 'user') WHERE len(w) > 0")
def _(s, d):
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), 1, 16)
    rows = frame(s, d, "conversations").filter("role = 'user'").withColumn("w", words).filter("size(w) > 0")
    return rows.select("conv_id", "turn", demand.expand_template(F.lit("https://w.example.org/{query}/{title}/{slug}"), F.col("w")).alias("url"))


# ---- search ----

TOKENS = "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}]+')"
#: Oracle of the index: postings with weights, document lengths, BM25.
INDEX_SQL = f"""{ctes('pages_in')},
    tok AS (SELECT doc_id, url_key, 5.0 AS w, unnest({TOKENS.format('title')}) AS term FROM pages_in UNION ALL SELECT doc_id, url_key, 1.0, unnest({TOKENS.format('text')}) FROM pages_in),
    lens AS (SELECT p.url_key, coalesce(n, 0) AS len FROM pages_in p LEFT JOIN (SELECT url_key, count(*) AS n FROM tok GROUP BY 1) USING (url_key)),
    avgs AS (SELECT count(*) AS docs, avg(len) AS mean FROM lens),
    post AS (SELECT url_key, term, sum(w) AS tf FROM tok WHERE term IN ('the', 'thing', 'of') GROUP BY 1, 2),
    dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
    idf AS (SELECT term, CASE WHEN ln((docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - df + 0.5) / (df + 0.5)) END AS idf FROM dfs, avgs),
    scored AS (SELECT url_key, -list_sum(list_sort(list(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))))) AS fts, count(*) AS matched FROM post JOIN idf USING (term) JOIN lens USING (url_key), avgs GROUP BY 1),
    both_all AS (SELECT url_key, fts FROM scored WHERE matched = 3 ORDER BY fts, url_key LIMIT 300),
    both_any AS (SELECT url_key, fts FROM scored ORDER BY fts, url_key LIMIT 300)"""


def index_of(s, d):
    return search.build_index(frame(s, d, "pages_in"))


@query("bm25_and_topk", f"{INDEX_SQL} SELECT url_key, round(both_all.fts, 6) AS fts FROM both_all ORDER BY both_all.fts, url_key LIMIT 50")
def _(s, d):
    return search.top(search.bm25(index_of(s, d), search.terms_of(QUERY_TERMS)), 50).select(F.col("doc_key").alias("url_key"), F.round("fts", 6).alias("fts"))


@query("bm25_or_topk", f"{INDEX_SQL} SELECT url_key, round(both_any.fts, 6) AS fts FROM both_any ORDER BY both_any.fts, url_key LIMIT 50")
def _(s, d):
    return search.top(search.bm25(index_of(s, d), search.terms_of(QUERY_TERMS), "OR"), 50).select(F.col("doc_key").alias("url_key"), F.round("fts", 6).alias("fts"))


FILL_SQL = f"""{INDEX_SQL}, few AS (SELECT count(*) < 100 AS few FROM both_all),
    cand AS (SELECT url_key, fts, true AS every FROM both_all UNION ALL SELECT url_key, fts, false FROM both_any, few WHERE few AND url_key NOT IN (SELECT url_key FROM both_all))"""


@query("search_and_or_fill", f"{FILL_SQL} SELECT url_key, round(fts, 6) AS fts, every FROM cand")
def _(s, d):
    return search.candidates(index_of(s, d), search.terms_of(QUERY_TERMS)).select(F.col("doc_key").alias("url_key"), F.round("fts", 6).alias("fts"), "every")


RANK_SQL = f"""{FILL_SQL},
    sig AS (SELECT p.*, c.fts, c.every, {TOKENS.format('title')} AS tt, {TOKENS.format("host || ' ' || regexp_extract(url, '^https://[^/]*(.*)$', 1)")} AS ut, {TOKENS.format('text')} AS bt,
                   trim(regexp_replace(strip_accents(lower(title || ' ' || description || ' ' || text)), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS sq FROM pages_in p JOIN cand c USING (url_key)),
    cov AS (SELECT *, list_filter(['the', 'thing', 'of'], lambda x: list_contains(tt, x)) AS ht, list_filter(['the', 'thing', 'of'], lambda x: list_contains(ut, x)) AS hu,
                   CASE WHEN every THEN 3 ELSE len(list_filter(['the', 'thing', 'of'], lambda x: list_contains(tt, x) OR list_contains(ut, x) OR list_contains(bt, x))) END AS matched FROM sig),
    sc AS (SELECT *, {ROUND.format("(100.0 * (0.45 * (greatest(0, -fts) / (greatest(0, -fts) + 6.0)) + 0.20 * len(ht) / 3.0 + 0.10 * len(hu) / 3.0 + CASE WHEN contains(sq, 'the thing of') THEN 0.05 ELSE 0 END + 0.15 * matched / 3.0) * (matched / 3.0) * (matched / 3.0) * (1.0 + 0.10 * exp(-greatest(0, 852076800000 - last_changed_at) / 86400000.0 / 180.0)) * CASE WHEN low_value THEN 0.3 ELSE 1.0 END)")} AS score FROM cov WHERE matched > 0),
    div AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, url) - 1 AS n FROM sc)"""


@query("ranked_search", f"{RANK_SQL} SELECT url, host, CASE WHEN n = 0 THEN score ELSE {ROUND.format('(score * pow(0.85, n))')} END AS score, CAST(matched AS BIGINT) AS matched_terms, contains(sq, 'the thing of') AS phrase_match FROM div ORDER BY score DESC, url LIMIT 300")
def _(s, d):
    p = frame(s, d, "pages_in")
    return search.search(p, search.build_index(p), QUERY_TERMS, NOW).select("url", "host", "score", long(F.col("matched_terms")).alias("matched_terms"), "phrase_match")


@query("search_summary", f"{RANK_SQL}, fin AS (SELECT CASE WHEN n = 0 THEN score ELSE {ROUND.format('(score * pow(0.85, n))')} END AS score, matched FROM div ORDER BY score DESC, url LIMIT 300) SELECT count(*) AS total, CAST(sum(CASE WHEN matched = 3 AND score >= 25 THEN 1 ELSE 0 END) AS BIGINT) AS strong, max(score) AS best FROM fin")
def _(s, d):
    p = frame(s, d, "pages_in")
    return search.summary(search.search(p, search.build_index(p), QUERY_TERMS, NOW))


@query("page_offset", f"{RANK_SQL}, fin AS (SELECT url, CASE WHEN n = 0 THEN score ELSE {ROUND.format('(score * pow(0.85, n))')} END AS score FROM div) SELECT url, score FROM fin ORDER BY score DESC, url LIMIT 10 OFFSET 20")
def _(s, d):
    p = frame(s, d, "pages_in")
    return search.page_of(search.search(p, search.build_index(p), QUERY_TERMS, NOW), 10, 20).select("url", "score")


@query("plain_search", None)
def _(s, d):
    p = frame(s, d, "pages_in")
    return search.plain_search(p, search.build_index(p), "thing", 10)


@query("search_response", None)
def _(s, d):
    p = frame(s, d, "pages_in")
    return search.response(search.search(p, search.build_index(p), QUERY_TERMS, NOW), 1000, 0)


@query("variant_dedup", f"""WITH v AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_extract({PAGE_URL}, '^([^?]*)', 1), '^[a-z]+://', ''), '^www\\.', ''), '/+$', '') AS g, page_id % 7 AS score FROM pages)
        SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY g ORDER BY score DESC, url LIKE 'https:%' DESC, url, page_id) AS n FROM v) WHERE n = 1""")
def _(s, d):
    p = frame(s, d, "pages").withColumn("plain", F.regexp_replace("url", "[?#].*$", ""))
    rows = p.select("page_id", F.concat("url", F.lit(" "), F.lpad(F.col("page_id").cast("string"), 12, "0")).alias("url"), (F.col("page_id") % 7).alias("score"), F.col("url").startswith("https:").alias("https"), urls.variant_key(F.col("plain")).alias("variant_group"))
    return search.one_per_variant(rows).select("page_id")


@query("host_diversity", f"{ctes('urls')} SELECT url_key, CASE WHEN n = 0 THEN priority ELSE {ROUND.format('(priority * pow(0.85, n))')} END AS score FROM (SELECT url_key, CAST(priority AS DOUBLE) AS priority, row_number() OVER (PARTITION BY host ORDER BY priority DESC, url) - 1 AS n FROM urls)")
def _(s, d):
    rows = frame(s, d, "urls").select("url_key", "host", "url", F.col("priority").cast("double").alias("score"), F.lit(True).alias("https"))
    return search.diversified(rows).select("url_key", "score")


DOM = "regexp_replace({}, '^[^.]*\\.', '')"


@query("inbound_domains", f"{ctes('links')} SELECT dst_key, count(DISTINCT {DOM.format('src_host')}) AS inbound FROM links WHERE {DOM.format('src_host')} <> {DOM.format('dst_host')} GROUP BY 1")
def _(s, d):
    links = frame(s, d, "links")
    return search.inbound_domains(links, host_domains(links, "src_host", "dst_host"))


# ---- corpus ----


@query("exact_dedup", f"{ctes('pages_in')} SELECT url_key, CASE WHEN first <> url_key THEN first END AS duplicate_of FROM (SELECT url_key, first_value(url_key) OVER (PARTITION BY content_sha256 ORDER BY fetched_at, url_key) AS first FROM pages_in)")
def _(s, d):
    return corpus.first_of_hash(frame(s, d, "pages_in")).select("url_key", "duplicate_of")


@query("duplicate_rate", f"{ctes('pages_in')} SELECT count(*) AS total, count(*) - count(DISTINCT content_sha256) AS duplicates, {R4.format('(count(*) - count(DISTINCT content_sha256)) * 1.0 / count(*)')} AS duplicate_rate FROM pages_in")
def _(s, d):
    return analytics.document_report(corpus.first_of_hash(frame(s, d, "pages_in")))


@query("canonical_dedup", None)
def _(s, d):
    p = frame(s, d, "pages_in")
    named = p.withColumn("canonical_key", F.when(F.col("doc_id") % 50 == 3, urls.url_key(F.concat(F.lit("https://"), F.col("host"), F.lit("/"), (F.col("doc_id") - 3).cast("string")))))
    return corpus.duplicates(named)


@query("change_tracking", f"""{ctes('pages_in')}, old AS (SELECT * FROM pages_in WHERE doc_id % 3 <> 0), new AS (SELECT url_key, CASE WHEN doc_id % 5 = 0 THEN sha256(url) ELSE content_sha256 END AS content_sha256, fetched_at + 1000 AS fetched_at FROM pages_in WHERE doc_id % 2 = 0)
        SELECT coalesce(n.url_key, o.url_key) AS url_key, coalesce(o.fetched_at, n.fetched_at) AS first_seen_at, CASE WHEN n.url_key IS NOT NULL AND (o.url_key IS NULL OR o.content_sha256 <> n.content_sha256) THEN n.fetched_at ELSE coalesce(o.last_changed_at, n.fetched_at) END AS last_changed_at,
               CAST(CASE WHEN n.url_key IS NOT NULL AND o.url_key IS NOT NULL AND o.content_sha256 <> n.content_sha256 THEN 1 ELSE 0 END AS BIGINT) AS change_count FROM old o FULL JOIN new n ON o.url_key = n.url_key""")
def _(s, d):
    p = frame(s, d, "pages_in").withColumn("http_status", F.lit(200))
    old = p.filter("doc_id % 3 <> 0").withColumn("first_seen_at", F.col("fetched_at")).withColumn("change_count", F.lit(0).cast("long"))
    new = p.filter("doc_id % 2 = 0").withColumn("content_sha256", F.when(F.col("doc_id") % 5 == 0, F.sha2("url", 256)).otherwise(F.col("content_sha256"))).withColumn("fetched_at", F.col("fetched_at") + 1000)
    return corpus.change_tracking(old, new).select("url_key", "first_seen_at", "last_changed_at", "change_count")


@query("change_tracking_all", None)
def _(s, d):
    """As change_tracking, but every document is in at least one of the two tables."""
    p = frame(s, d, "pages_in").withColumn("http_status", F.lit(200))
    old = p.filter("doc_id % 3 <> 0").withColumn("first_seen_at", F.col("fetched_at")).withColumn("change_count", F.lit(0).cast("long"))
    new = p.filter("doc_id % 2 = 0 or doc_id % 3 = 0").withColumn("content_sha256", F.when(F.col("doc_id") % 5 == 0, F.sha2("url", 256)).otherwise(F.col("content_sha256"))).withColumn("fetched_at", F.col("fetched_at") + 1000)
    return corpus.change_tracking(old, new).select("url_key", "first_seen_at", "last_changed_at", "change_count")


@query("duplicate_promotion", f"""{ctes('pages_in')}, dup AS (SELECT *, first_value(url_key) OVER (PARTITION BY content_sha256 ORDER BY fetched_at, url_key) AS first FROM pages_in), rest AS (SELECT * FROM dup WHERE NOT (first = url_key AND doc_id % 2 = 0)),
        heir AS (SELECT *, first_value(url_key) OVER (PARTITION BY content_sha256 ORDER BY fetched_at, url_key) AS now_first FROM rest) SELECT url_key, CASE WHEN now_first <> url_key THEN now_first END AS duplicate_of FROM heir""")
def _(s, d):
    p = corpus.first_of_hash(frame(s, d, "pages_in"))
    return corpus.removed(p, p.filter("duplicate_of is null and doc_id % 2 = 0").select("url_key")).select("url_key", "duplicate_of")


@query("corpus_counts", f"{ctes('pages_in', 'links')} SELECT 'documents' AS k, count(*) AS n FROM pages_in UNION ALL SELECT 'duplicates', count(*) - count(DISTINCT content_sha256) FROM pages_in UNION ALL SELECT 'indexed', count(DISTINCT content_sha256) FROM pages_in UNION ALL SELECT 'links', count(*) FROM links")
def _(s, d):
    return corpus.counts(corpus.first_of_hash(frame(s, d, "pages_in")), frame(s, d, "links"))


@query("replace_links", f"""{ctes('links')}, n AS (SELECT src_key, dst_key, src_host, dst_host, dst_url FROM links WHERE src_key LIKE 'p1%') SELECT src_key, count(*) AS n FROM (SELECT src_key FROM links WHERE src_key NOT LIKE 'p1%' UNION ALL SELECT src_key FROM (SELECT *, row_number() OVER (PARTITION BY src_key ORDER BY dst_key) AS r FROM n) WHERE r <= 100) GROUP BY 1""")
def _(s, d):
    links = frame(s, d, "links")
    new = links.filter("src_key like 'p1%'").withColumn("seq", F.row_number().over(Window.partitionBy("src_key").orderBy("dst_key")))
    return corpus.replace_links(links, new.select("src_key"), new).groupBy("src_key").agg(F.count("*").alias("n"))


@query("language_share", f"SELECT coalesce(nullif(lang, ''), 'unknown') AS key, count(*) AS n, {R4.format('count(*) * 1.0 / sum(count(*)) OVER ()')} AS share FROM documents GROUP BY 1 ORDER BY n DESC, key LIMIT 10")
def _(s, d):
    return analytics.top_shares(analytics.languages(frame(s, d, "documents").withColumnRenamed("lang", "language")))


# ---- frontier ----

DUE = """(next_at <= 852076800000 AND host NOT IN (SELECT host FROM hosts WHERE next_allowed_at > 852076800000 OR backoff_until > 852076800000) AND host NOT IN (SELECT host FROM urls WHERE state = 'IN_FLIGHT')
          AND ((state = 'PENDING' AND queue = 'DEMAND') OR (state = 'DONE' AND content_sha256 IS NOT NULL) OR domain NOT IN (SELECT domain FROM health WHERE cooldown_until > 852076800000)))"""


def parts(s, d, *names: str) -> list[DataFrame]:
    return [frame(s, d, n) for n in names]


@query("due_urls", f"{ctes('urls', 'hosts', 'health')} SELECT url_key, state FROM urls WHERE {DUE}")
def _(s, d):
    return frontier.due(*parts(s, d, "urls", "hosts", "health"), NOW).select("url_key", "state")


@query("ready_domains", f"{ctes('urls', 'hosts', 'health')} SELECT domain FROM domains WHERE pending > 0 AND in_flight < 7 AND domain NOT IN (SELECT domain FROM health WHERE cooldown_until > 852076800000) AND domain IN (SELECT domain FROM urls WHERE state = 'PENDING' AND queue = 'PUBLIC' AND {DUE})")
def _(s, d):
    return frontier.ready_domains(*parts(s, d, "urls", "hosts", "domains", "health"), NOW, Policy(domain_concurrency=7)).select("domain")


@query("recrawl_spread", f"{ctes('urls')} SELECT url_key, CASE WHEN row_number() OVER (PARTITION BY domain ORDER BY next_at, url_key) = 1 THEN 0 ELSE 1 END AS turn FROM urls WHERE state = 'DONE'")
def _(s, d):
    return frontier.recrawl_spread(frame(s, d, "urls").filter("state = 'DONE'")).select("url_key", "turn")


@query("fair_picks", f"{ctes('domains')}, first AS (SELECT domain, vtime, pending, {WEIGHT} AS weight FROM domains WHERE pending > 0 ORDER BY vtime, domain LIMIT 50), picks AS (SELECT domain, vtime, weight, unnest(range(1, least(50, pending) + 1)) AS k FROM first) SELECT domain, k, round(vtime + (k - 1) / weight, 6) AS stands_at FROM picks ORDER BY vtime + (k - 1) / weight, domain, k LIMIT 50")
def _(s, d):
    return frontier.fair_picks(frame(s, d, "domains"), NOW, 50).select("domain", "k", F.round("at", 6).alias("stands_at"))


@query("lease", None)
def _(s, d):
    return frontier.lease(*parts(s, d, "urls", "hosts", "domains", "health"), NOW, 16, Policy(domain_concurrency=20, family_concurrency=80))


@query("requeue_stale", f"{ctes('urls')} SELECT url_key, CASE WHEN state = 'IN_FLIGHT' AND leased_at <= 852076800000 - 300000 THEN 'PENDING' ELSE state END AS state FROM urls")
def _(s, d):
    return frontier.requeued(frame(s, d, "urls"), NOW).select("url_key", "state")


@query("release", f"{ctes('urls')} SELECT url_key, CASE WHEN state = 'IN_FLIGHT' AND priority < 50 THEN 'PENDING' ELSE state END AS state, CASE WHEN state = 'IN_FLIGHT' AND priority < 50 THEN 852076800000 + 5000 ELSE next_at END AS next_at FROM urls")
def _(s, d):
    u = frame(s, d, "urls")
    return frontier.released(u, u.filter("priority < 50").select("url_key"), NOW, 5000).select("url_key", "state", "next_at")


def offers(s, d) -> DataFrame:
    """Links that ask for admission, one of each row; rows of the same order and line arrive one after another."""
    # Rows alike in these four columns make the same offers, so further columns need not order them (nor be dealt out).
    lines = frame(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    again = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey"))
    lines = lines.withColumn("again", again.cast("long"))
    k = F.shiftleft(F.col("l_orderkey") * 10 + F.col("l_linenumber"), 20) + F.col("again")
    return lines.select(k.alias("arrival"), F.concat(F.lit("https://h"), (F.col("l_suppkey") % 40).cast("string"), F.lit(".d"), (F.col("l_suppkey") % 23).cast("string"), F.lit(".example/n/"), (F.col("l_partkey") % 5000).cast("string"), F.when(F.col("l_partkey") % 10 == 0, ".jpg").when(F.col("l_partkey") % 10 == 1, "?sort=up").otherwise("")).alias("raw"), F.lit("PUBLIC").alias("queue"), F.lit("discovered").alias("source"), (F.col("l_partkey") % 10).alias("depth"), F.lit(False).alias("external"), F.lit(False).alias("relevant"))


OFFERS = """SELECT min_by(raw, l_partkey) AS raw, arrival, min(depth) AS depth FROM (SELECT l_orderkey * 10 + l_linenumber AS arrival, l_partkey, 'https://h' || (l_suppkey % 40) || '.d' || (l_suppkey % 23) || '.example/n/' || (l_partkey % 5000) || CASE l_partkey % 10 WHEN 0 THEN '.jpg' WHEN 1 THEN '?sort=up' ELSE '' END AS raw, l_partkey % 10 AS depth FROM lineitem WHERE l_linenumber = 1) GROUP BY arrival"""


@query("admission_verdicts", None)
def _(s, d):
    u, dom, health = parts(s, d, "urls", "domains", "health")
    return frontier.admit(offers(s, d), u, dom, health, Policy(max_pending_per_domain=600, max_pending_per_family=6000)).select("arrival", "url", "verdict", "priority")


@query("admission_counts", None)
def _(s, d):
    u, dom, health = parts(s, d, "urls", "domains", "health")
    return frontier.admission_counts(frontier.admit(offers(s, d), u, dom, health, Policy(max_pending_per_domain=600, max_pending_per_family=6000)))


@query("demand_promotion", f"""{ctes('urls')} SELECT url_key, CASE WHEN depth = 4 AND state = 'PENDING' THEN 'DEMAND' ELSE queue END AS queue, CASE WHEN depth = 4 AND state = 'PENDING' THEN 100 ELSE priority END AS priority,
        CASE WHEN depth = 4 AND ((state = 'PENDING' AND attempts = 0) OR (state = 'DONE' AND 852076800000 - coalesce(fetched_at, 0) >= 21600000)) THEN least(next_at, 852076800000) ELSE next_at END AS next_at FROM urls""")
def _(s, d):
    u = frame(s, d, "urls")
    asked = u.filter("depth = 4").select("url_key", F.lit("DEMAND").alias("queue"), F.lit("demand").alias("source"), F.lit(100).cast("long").alias("priority"))
    return frontier.promote(u, asked, NOW).select("url_key", "queue", "priority", "next_at")


@query("first_vtime", f"{ctes('domains')} SELECT 'new' || p AS domain, floor((SELECT min(vtime) FROM domains WHERE pending > 0)) + (100 - p) / 1000.0 AS vtime FROM (SELECT unnest([10, 50, 100]) AS p)")
def _(s, d):
    new = s.createDataFrame([(f"new{p}", p) for p in (10, 50, 100)], "domain string, priority int")
    return frontier.first_vtime(frame(s, d, "domains"), new).select("domain", F.col("vtime").cast("double").alias("vtime"))


def results(s, d) -> DataFrame:
    """A fetch result for each URL, all outcomes in turn."""
    u = frame(s, d, "urls")
    names = F.array(*map(F.lit, frontier.OUTCOMES))
    n = (F.col("priority") + F.col("depth")) % 12
    return u.withColumns({"outcome": F.get(names, n.cast("int")), "http_status": F.when(n == 10, F.when(F.col("depth") < 3, 404).when(F.col("depth") < 6, 503).otherwise(403)).when(n == 0, 200), "retry_after_sec": F.when(F.col("depth") % 2 == 0, F.lit(120).cast("long")), "retryable": F.col("depth") % 3 != 0, "new_sha256": F.sha2("url", 256), "referring": F.col("priority") % 8, "failures": F.col("depth") % 4, "crawl_delay_sec": F.when(F.col("priority") % 10 == 0, F.lit(5).cast("long"))})


@query(
    "transition_12_outcomes",
    f"""{ctes('urls')}, r AS (SELECT *, [{listed(frontier.OUTCOMES)}][CAST((priority + depth) % 12 + 1 AS INT)] AS outcome, (priority + depth) % 12 AS n, CASE WHEN depth % 2 = 0 THEN 120000 ELSE 0 END AS retry, CASE WHEN depth < 3 THEN 404 WHEN depth < 6 THEN 503 ELSE 403 END AS st, greatest(2000, CASE WHEN priority % 10 = 0 THEN 5000 ELSE 0 END) AS delay, coalesce(interval_ms, 604800000) AS cur FROM urls),
        t AS (SELECT *, outcome = 'ROBOTS_UNAVAILABLE' OR (outcome = 'HTTP_ERROR' AND st = 503) OR (outcome = 'FETCH_FAILED' AND depth % 3 <> 0) AS again FROM r),
        w AS (SELECT *, greatest(CAST(60000 * pow(2, attempts) AS BIGINT), CASE WHEN outcome = 'FETCH_FAILED' THEN 0 ELSE retry END) AS wait FROM t)
        SELECT url_key, CASE WHEN again AND attempts + 1 >= 5 THEN 'FAILED' WHEN again OR outcome IN ('ROBOTS_DISALLOWED', 'RATE_LIMITED') THEN 'PENDING' WHEN outcome = 'BLOCKED_TARGET' THEN 'BLOCKED' WHEN outcome = 'FETCH_FAILED' THEN 'FAILED' ELSE 'DONE' END AS new_state,
               CAST(852076800000 + CASE WHEN again AND attempts + 1 >= 5 THEN 2592000000 WHEN again THEN wait WHEN outcome = 'FETCHED' THEN CASE WHEN content_sha256 IS NULL THEN cur WHEN content_sha256 <> sha256(url) THEN greatest(21600000, floor(cur / 2.0 + 0.5)) ELSE least(CASE WHEN priority % 8 >= 5 THEN 1209600000 ELSE 5184000000 END, cur * 2) END
                    WHEN outcome = 'NOT_MODIFIED' THEN least(CASE WHEN priority % 8 >= 5 THEN 1209600000 ELSE 5184000000 END, cur * 2) WHEN outcome = 'PROBED' THEN cur WHEN outcome = 'ROBOTS_DISALLOWED' THEN 86400000 WHEN outcome = 'RATE_LIMITED' THEN greatest(delay, retry) WHEN outcome = 'HTTP_ERROR' AND st = 403 THEN 1209600000 ELSE 2592000000 END AS BIGINT) AS new_next_at,
               CAST(CASE WHEN again THEN attempts + 1 WHEN outcome = 'RATE_LIMITED' THEN attempts ELSE 0 END AS BIGINT) AS new_attempts, CAST(852076800000 + CASE WHEN outcome = 'RATE_LIMITED' THEN greatest(delay, retry) ELSE delay END AS BIGINT) AS host_next_allowed_at,
               CASE WHEN again THEN 852076800000 + greatest(wait, CAST(60000 * pow(2, depth % 4) AS BIGINT)) END AS host_backoff_until,
               outcome IN ('ROBOTS_UNAVAILABLE', 'ROBOTS_DISALLOWED', 'BLOCKED_TARGET', 'FETCH_FAILED', 'UNSUPPORTED_CONTENT_TYPE', 'TOO_LARGE', 'HTTP_ERROR') AND source <> 'sitemap' AS counts_as_error FROM w""",
)
def _(s, d):
    return frontier.transition(results(s, d), NOW).select("url_key", "new_state", "new_next_at", "new_attempts", "host_next_allowed_at", "host_backoff_until", "counts_as_error")


@query("applied_results", None)
def _(s, d):
    return frontier.applied(frame(s, d, "urls"), frontier.transition(results(s, d), NOW), NOW).select("url_key", "state", "next_at", "attempts", "generation", "last_outcome", "queue", "fetched_at", "interval_ms")


@query("cross_check", f"""{ctes('urls')} SELECT url_key, CASE WHEN priority % 20 = 3 THEN 'REQUESTED_URL_MISMATCH' WHEN priority % 20 = 4 THEN 'FINAL_URL_OFF_HOST' WHEN priority % 20 = 5 THEN 'REDIRECT_WITHOUT_TARGET' WHEN priority % 20 = 6 THEN 'FETCHED_INCOMPLETE' WHEN priority % 20 = 7 THEN 'HTTP_ERROR_STATUS' WHEN priority % 20 = 8 THEN 'RATE_LIMITED_WITHOUT_DELAY' WHEN priority % 20 = 9 THEN 'FAILED_WITHOUT_ERROR' END AS problem FROM urls""")
def _(s, d):
    n = F.col("priority") % 20
    rows = frame(s, d, "urls").withColumns({
        "requested_url": F.when(n == 3, "https://other.example/").otherwise(F.col("url")), "final_url": F.when(n == 4, F.lit("https://other.example/x")), "outcome": F.when(n == 5, "REDIRECT").when(n.isin(6, 10), "FETCHED").when(n == 7, "HTTP_ERROR").when(n == 8, "RATE_LIMITED").when(n == 9, "FETCH_FAILED").otherwise("PROBED"),
        "redirect_target": F.lit(None).cast("string"), "http_status": F.when(n == 10, 200).when(n == 7, 300), "title": F.lit("t"), "retry_after_sec": F.lit(None).cast("long"), "error_code": F.lit(None).cast("string"), "content_sha256": F.when(n == 10, "x"),
    })
    return rows.select("url_key", frontier.cross_check().alias("problem"))


def samples(s, d) -> DataFrame:
    e = frame(s, d, "events")
    return e.select(F.concat(F.lit("d"), (F.col("user_id") % 23).cast("string"), F.lit(".example")).alias("domain"), (F.lit(NOW) + F.col("event_id") * 60000).alias("ts"), F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("click", "view"), "useful").when(F.col("event_type") == "purchase", "duplicate").otherwise("error").alias("kind"), (F.col("event_type") != "signup").alias("affects_health"))


FOLD_SQL = f"""{ctes('health')}, ev AS MATERIALIZED (SELECT 'd' || (user_id % 23) || '.example' AS domain, 852076800000 + event_id * 60000 AS ts, event_type IN ('click', 'view') AS useful, event_type <> 'signup' AS affects, row_number() OVER (PARTITION BY user_id % 23 ORDER BY event_id) AS n FROM events)"""


@query("ewma_yield", f"""WITH RECURSIVE {FOLD_SQL.removeprefix('WITH ')}, f AS (SELECT d.domain, CAST(0 AS BIGINT) AS n, CAST(yield AS DOUBLE) AS y, yield_at AS seen FROM domains d
        UNION ALL SELECT f.domain, e.n, least(1.0, greatest(0.0, (0.5 + (f.y - 0.5) * pow(0.5, CASE WHEN f.seen > 0 THEN greatest(0, e.ts - f.seen) ELSE 0 END / 604800000.0)) * 0.9 + CASE WHEN e.useful THEN 0.1 ELSE 0.0 END)), e.ts FROM f JOIN ev e ON e.domain = f.domain AND e.n = f.n + 1)
        SELECT domain, round(y, 6) AS yield, seen AS yield_at FROM f WHERE n > 0 AND n = (SELECT max(n) FROM ev WHERE ev.domain = f.domain)""")
def _(s, d):
    return frontier.fold_samples(samples(s, d), frame(s, d, "domains"), frame(s, d, "health")).select("domain", F.round("yield", 6).alias("yield"), "yield_at")


@query("bad_streak", f"""{FOLD_SQL}, z AS (SELECT domain, max(CASE WHEN affects AND useful THEN n END) AS last_useful FROM ev GROUP BY 1),
        c AS (SELECT e.domain, count(*) FILTER (WHERE affects AND NOT useful AND (last_useful IS NULL OR n > last_useful)) AS bad, max(CASE WHEN affects THEN ts END) AS ts, any_value(last_useful) AS last_useful FROM ev e JOIN z USING (domain) GROUP BY 1),
        k AS (SELECT c.domain, least(32, bad + CASE WHEN last_useful IS NULL THEN coalesce(h.bad_streak, 0) ELSE 0 END) AS bad_streak, ts FROM c JOIN domains USING (domain) LEFT JOIN health h USING (domain))
        SELECT domain, CAST(bad_streak AS BIGINT) AS bad_streak, CASE WHEN bad_streak < 8 THEN 0 ELSE ts + CAST(least(21600000, 60000 * pow(2, bad_streak - 8)) AS BIGINT) END AS cooldown_until FROM k""")
def _(s, d):
    return frontier.fold_samples(samples(s, d), frame(s, d, "domains"), frame(s, d, "health")).select("domain", "bad_streak", "cooldown_until")


@query("link_fanout", f"""{ctes('links')}, l AS (SELECT src_key, dst_url AS url, {DOM.format('dst_host')} AS domain, CASE WHEN {DOM.format('src_host')} <> {DOM.format('dst_host')} THEN 'external' WHEN src_host <> dst_host THEN 'sibling' ELSE 'internal' END AS kind, CAST(regexp_extract(dst_key, '[0-9]+') AS BIGINT) AS seq FROM links),
        a AS (SELECT *, CASE kind WHEN 'external' THEN CASE WHEN row_number() OVER (PARTITION BY src_key, kind, domain ORDER BY seq) > 1 THEN 1 ELSE 0 END WHEN 'internal' THEN seq % 2 ELSE 0 END AS later FROM l),
        b AS (SELECT *, row_number() OVER (PARTITION BY src_key, kind ORDER BY later, seq) AS turn FROM a) SELECT src_key, url, kind, CAST(turn AS INT) AS turn FROM b WHERE turn <= CASE kind WHEN 'external' THEN 40 WHEN 'internal' THEN 25 ELSE 2 END""")
def _(s, d):
    links = frame(s, d, "links")
    dom = lambda c: F.regexp_replace(c, r"^[^.]*\.", "")
    seq = F.regexp_extract("dst_key", "[0-9]+", 0).cast("long")
    rows = links.select("src_key", F.col("dst_url").alias("url"), dom("dst_host").alias("domain"), F.when(dom("src_host") != dom("dst_host"), "external").when(F.col("src_host") != F.col("dst_host"), "sibling").otherwise("internal").alias("kind"), seq.alias("seq"), (seq % 2 == 0).alias("relevant"), F.lit(False).alias("foreign_page"))
    return frontier.choose_links(rows)


@query("ref_domains", f"{ctes('links')} SELECT {DOM.format('dst_host')} AS domain, count(DISTINCT {DOM.format('src_host')}) AS ref_domains FROM links WHERE {DOM.format('src_host')} <> {DOM.format('dst_host')} GROUP BY 1")
def _(s, d):
    links = frame(s, d, "links")
    return frontier.referring_domains(links, host_domains(links, "src_host", "dst_host"))


@query("page_link_resolution", None)
def _(s, d):
    p = frame(s, d, "pages").select(F.col("page_id").cast("string").alias("src_key"), F.regexp_replace("url", "#.*$", "").alias("url"), urls.host_of(F.col("url")).alias("host"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.transform(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), lambda u: F.struct(u.alias("url"), F.lit(False).alias("nofollow"))).alias("links"))
    hosts = p.select("host").distinct().select("host", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("domain"))
    return frontier.page_links(p, hosts).select("src_key", "seq", "url", "domain", "kind", "relevant")


@query("sitemap_ingest", None)
def _(s, d):
    p = frame(s, d, "pages").select("page_id", urls.host_of(F.col("url")).alias("host"), F.regexp_replace("url", "#.*$", "").alias("u"))
    files = p.groupBy("host").agg(F.array_join(F.array_sort(F.collect_list("u")), "\n").alias("body")).withColumn("file_key", F.col("host"))
    hosts = p.select("host").distinct().select("host", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("domain"))
    return frontier.sitemap_urls(files, hosts)


@query("sitemap_probes", f"{ctes('domains')} SELECT DISTINCT regexp_extract(url, '^(https://[^/]+)', 1) || '/sitemap.txt' AS url FROM urls WHERE domain IN (SELECT domain FROM domains WHERE useful >= 3)")
def _(s, d):
    return frontier.sitemap_probes(frame(s, d, "domains"), frame(s, d, "urls"))


# ---- analytics ----


@query("state_counts", f"{ctes('urls')} SELECT state, count(*) AS n FROM urls GROUP BY 1")
def _(s, d):
    return analytics.state_counts(frame(s, d, "urls"))


@query("domain_counters", f"{ctes('urls')} SELECT domain, count(*) AS urls, count(*) FILTER (WHERE state = 'PENDING') AS pending, count(*) FILTER (WHERE state = 'PENDING' AND queue = 'DEMAND') AS pending_demand, count(*) FILTER (WHERE state = 'IN_FLIGHT') AS in_flight, count(*) FILTER (WHERE state = 'DONE') AS done, count(*) FILTER (WHERE state = 'FAILED') AS failed FROM urls GROUP BY 1")
def _(s, d):
    return analytics.domain_counters(frame(s, d, "urls"))


@query("host_domain_family_rollup", f"""{ctes('urls')}, f AS (SELECT *, CASE WHEN domain IN ('d1.example', 'd2.example') THEN 'ones' ELSE domain END AS family FROM urls), g AS (SELECT 'host' AS level, host AS key, state FROM f UNION ALL SELECT 'domain', domain, state FROM f UNION ALL SELECT 'family', family, state FROM f)
        SELECT level, key, count(*) FILTER (WHERE state = 'PENDING') AS pending, count(*) FILTER (WHERE state = 'DONE') AS done FROM g GROUP BY 1, 2""")
def _(s, d):
    return analytics.host_rollup(frame(s, d, "urls"), {"ones": ["d1.example", "d2.example"]})


@query("topn_share", f"{ctes('urls')} SELECT domain AS key, count(*) AS n, {R4.format('count(*) * 1.0 / sum(count(*)) OVER ()')} AS share FROM urls WHERE state = 'PENDING' GROUP BY 1 ORDER BY n DESC, key LIMIT 10")
def _(s, d):
    return analytics.top_shares(analytics.tally(frame(s, d, "urls").filter("state = 'PENDING'"), "domain"))


@query("pending_spread", f"""{ctes('urls')}, c AS (SELECT domain AS key, count(*) AS n FROM urls WHERE state = 'PENDING' GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, key) AS r FROM c), t AS (SELECT sum(n) AS total, sum(n * n) * 1.0 / (sum(n) * sum(n)) AS h FROM c)
        SELECT CAST(total AS BIGINT) AS total, {R4.format('(SELECT sum(n) FROM r WHERE r <= 1) * 1.0 / total')} AS top1, {R4.format('(SELECT sum(n) FROM r WHERE r <= 5) * 1.0 / total')} AS top5, {R4.format('(SELECT sum(n) FROM r WHERE r <= 10) * 1.0 / total')} AS top10, {R4.format('h')} AS herfindahl, {R4.format('1.0 / h')} AS effective, (SELECT key FROM r WHERE r = 1) AS top_key FROM t""")
def _(s, d):
    return analytics.spread(analytics.tally(frame(s, d, "urls").filter("state = 'PENDING'"), "domain"))


@query("concentration", f"""{ctes('domains')}, l AS (SELECT 'domain' AS level, domain AS key, 'pending' AS measure, pending AS n FROM domains UNION ALL SELECT 'domain', domain, 'done', done FROM domains UNION ALL SELECT 'domain', domain, 'useful', useful FROM domains
        UNION ALL SELECT 'family', family, 'pending', sum(pending) FROM domains GROUP BY family UNION ALL SELECT 'family', family, 'done', sum(done) FROM domains GROUP BY family UNION ALL SELECT 'family', family, 'useful', sum(useful) FROM domains GROUP BY family),
        r AS (SELECT *, row_number() OVER (PARTITION BY level, measure ORDER BY n DESC, key) AS r FROM l WHERE n > 0)
        SELECT level, measure, CAST(sum(n) AS BIGINT) AS total, {R4.format('sum(CASE WHEN r = 1 THEN n END) * 1.0 / sum(n)')} AS top1, {R4.format('sum(CASE WHEN r <= 5 THEN n END) * 1.0 / sum(n)')} AS top5, {R4.format('sum(n * n) * 1.0 / (sum(n) * sum(n))')} AS herfindahl, {R4.format('1.0 / (sum(n * n) * 1.0 / (sum(n) * sum(n)))')} AS effective, max(CASE WHEN r = 1 THEN key END) AS top_key FROM r GROUP BY 1, 2""")
def _(s, d):
    return analytics.concentration(frame(s, d, "domains"))


@query("concentration_warnings", None)
def _(s, d):
    return analytics.concentration_warnings(analytics.concentration(frame(s, d, "domains")))


@query("depth_queue_source", f"{ctes('urls')} SELECT 'depth' AS section, CAST(depth AS VARCHAR) AS key, count(*) AS n FROM urls WHERE state = 'PENDING' GROUP BY 2 UNION ALL SELECT 'queue', queue, count(*) FROM urls WHERE state = 'PENDING' GROUP BY 2 UNION ALL SELECT 'source', CASE WHEN queue = 'DEMAND' THEN 'demand' WHEN depth = 0 THEN 'seed_or_redirect' ELSE 'discovered' END, count(*) FROM urls GROUP BY 2 UNION ALL SELECT 'outcome', coalesce(last_outcome, 'NONE'), count(*) FROM urls WHERE state <> 'PENDING' OR attempts > 0 GROUP BY 2")
def _(s, d):
    report = analytics.analyze(frame(s, d, "urls"))
    out = None
    for section, name in (("depth", "depth"), ("queue", "queues"), ("source", "sources"), ("outcome", "outcomes")):
        part = report[name].select(F.lit(section).alias("section"), F.col("key").cast("string").alias("key"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("failure_rate", f"{ctes('urls')} SELECT count(*) FILTER (WHERE t) AS attempted, count(*) FILTER (WHERE state = 'FAILED') + count(*) FILTER (WHERE t AND last_outcome IN ('FETCH_FAILED', 'HTTP_ERROR', 'ROBOTS_UNAVAILABLE')) AS failed, {R4.format('(count(*) FILTER (WHERE state = chr(70) || chr(65) || chr(73) || chr(76) || chr(69) || chr(68)) + count(*) FILTER (WHERE t AND bad)) * 1.0 / count(*) FILTER (WHERE t)')} AS rate FROM (SELECT *, state <> 'PENDING' OR attempts > 0 AS t, coalesce(last_outcome IN ('FETCH_FAILED', 'HTTP_ERROR', 'ROBOTS_UNAVAILABLE'), false) AS bad FROM urls)")
def _(s, d):
    return analytics.failure_rate(frame(s, d, "urls"))


@query("link_locality", f"{ctes('links')} SELECT count(*) AS total, count(*) FILTER (WHERE src_host = dst_host) AS internal_host, count(*) FILTER (WHERE {DOM.format('src_host')} = {DOM.format('dst_host')}) AS internal_domain, count(DISTINCT CASE WHEN {DOM.format('src_host')} <> {DOM.format('dst_host')} THEN {DOM.format('dst_host')} END) AS external_domains, count(*) FILTER (WHERE {DOM.format('src_host')} <> {DOM.format('dst_host')}) AS external_domain, {R4.format('count(*) FILTER (WHERE ' + DOM.format('src_host') + ' <> ' + DOM.format('dst_host') + ') * 1.0 / count(*)')} AS external_share FROM links")
def _(s, d):
    links = frame(s, d, "links")
    return analytics.link_locality(links, host_domains(links, "src_host", "dst_host"))


@query("queue_health", f"""{ctes('urls', 'retries')} SELECT queue, count(*) AS n_rows, count(*) FILTER (WHERE state = 'PENDING') AS pending, count(*) FILTER (WHERE state = 'IN_FLIGHT') AS in_flight, count(*) FILTER (WHERE state = 'FAILED') AS failed, count(*) FILTER (WHERE state = 'PENDING' AND next_at <= 852076800000) AS due, count(*) FILTER (WHERE state = 'PENDING' AND attempts > 0) AS retrying,
        count(*) FILTER (WHERE state = 'PENDING' AND attempts > 0 AND 852076800000 - first_at < 3600000) AS under_hour, count(*) FILTER (WHERE state = 'PENDING' AND attempts > 0 AND 852076800000 - first_at >= 3600000 AND 852076800000 - first_at < 86400000) AS hour_to_day, count(*) FILTER (WHERE state = 'PENDING' AND attempts > 0 AND 852076800000 - first_at >= 86400000) AS over_day,
        count(*) FILTER (WHERE state = 'PENDING' AND attempts > 0 AND first_at IS NULL) AS age_unknown, max(CASE WHEN state = 'PENDING' THEN greatest(0, 852076800000 - discovered_at) ELSE 0 END) AS oldest_pending_ms FROM urls LEFT JOIN retries USING (url_key) GROUP BY 1""")
def _(s, d):
    return analytics.queue_health(frame(s, d, "urls"), frame(s, d, "retries"), NOW)


@query("low_yield_domains", f"{ctes('health')} SELECT d.domain, family, pending, leased, fetched, useful, errors, yield, coalesce(bad_streak, 0) AS bad_streak, coalesce(cooldown_until, 0) AS cooldown_until FROM domains d LEFT JOIN health h ON d.domain = h.domain WHERE pending > 0 AND leased >= 8 AND useful * 10 < leased ORDER BY pending DESC, d.domain LIMIT 25")
def _(s, d):
    return analytics.low_yield(frame(s, d, "domains"), frame(s, d, "health"))


@query("yield_totals", f"{ctes('domains')} SELECT 'low' AS kind, count(*) AS domains, CAST(coalesce(sum(pending), 0) AS BIGINT) AS pending FROM domains WHERE pending > 0 AND leased >= 8 AND useful * 10 < leased UNION ALL SELECT 'zero', count(*), CAST(coalesce(sum(pending), 0) AS BIGINT) FROM domains WHERE pending > 0 AND leased >= 8 AND useful = 0")
def _(s, d):
    return analytics.yield_totals(frame(s, d, "domains"))


@query("page_quality", f"{ctes('domains')} SELECT CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum(useful) AS BIGINT) AS useful, CAST(sum(duplicates) AS BIGINT) AS duplicates, CAST(sum(low_value) AS BIGINT) AS low_value, CAST(sum(errors) AS BIGINT) AS errors FROM domains")
def _(s, d):
    return analytics.page_quality(frame(s, d, "domains"))


@query("outcome_counts", f"{ctes('outcomes')} SELECT queue, outcome, error, count(*) AS n FROM outcomes GROUP BY 1, 2, 3")
def _(s, d):
    return analytics.outcome_counts(frame(s, d, "outcomes"))


@query("hourly_throughput", f"{ctes('outcomes')} SELECT date_trunc('hour', ts) AS hour, queue, count(*) AS answers, count(*) FILTER (WHERE outcome = 'FETCHED') AS fetched FROM outcomes GROUP BY 1, 2")
def _(s, d):
    return analytics.hourly(frame(s, d, "outcomes"))


@query("previous_hour", f"{ctes('outcomes')} SELECT queue, count(*) AS answers, count(*) FILTER (WHERE outcome = 'FETCHED') AS fetched, count(*) FILTER (WHERE outcome = 'FETCHED') / 60.0 AS fetched_per_minute FROM outcomes WHERE date_trunc('hour', ts) = TIMESTAMP '2024-01-01 05:00:00' GROUP BY 1")
def _(s, d):
    return analytics.throughput(analytics.hourly(frame(s, d, "outcomes")), F.lit("2024-01-01 06:00:00").cast("timestamp_ntz")).withColumn("fetched_per_minute", F.col("fetched_per_minute").cast("double"))


@query("seed_verdict", f"""{ctes('domains')} SELECT url, u.domain, state, CASE WHEN last_outcome IS NULL THEN 'NOT_YET_FETCHED' WHEN last_outcome = 'REDIRECT' THEN 'REDIRECTED' WHEN last_outcome IN ('ROBOTS_DISALLOWED', 'BLOCKED_TARGET') THEN 'BLOCKED' WHEN state = 'FAILED' OR last_outcome = 'FETCH_FAILED' OR (last_outcome = 'HTTP_ERROR' AND last_http >= 400) THEN 'DEGRADED'
        WHEN fetched_at IS NOT NULL AND 852076800000 - fetched_at > 7776000000 THEN 'STALE' ELSE 'HEALTHY' END AS verdict, {ROUND.format('d.yield')} AS domain_yield FROM urls u JOIN domains d ON u.domain = d.domain WHERE source = 'seed'""")
def _(s, d):
    return analytics.seed_health(frame(s, d, "urls"), frame(s, d, "domains"), NOW).select("url", "domain", "state", "verdict", "domain_yield")


@query("domain_detail", f"{ctes('hosts')} SELECT u.host, n, failures, CAST(greatest(0, floor((backoff_until - 852076800000) / 1000.0 + 0.5)) AS BIGINT) AS backoff_sec, CAST(greatest(0, floor((next_allowed_at - 852076800000) / 1000.0 + 0.5)) AS BIGINT) AS delay_sec FROM (SELECT host, count(*) AS n FROM urls WHERE domain = 'd7.example' GROUP BY 1) u LEFT JOIN hosts h ON u.host = h.host ORDER BY n DESC, u.host LIMIT 25")
def _(s, d):
    return analytics.domain_hosts(frame(s, d, "urls"), frame(s, d, "hosts"), "d7.example", NOW)


@query("domain_top_pending", f"{ctes('urls')} SELECT url, priority, depth, source, external FROM urls WHERE domain = 'd7.example' AND state = 'PENDING' ORDER BY priority DESC, url_key LIMIT 10")
def _(s, d):
    return analytics.domain_top_pending(frame(s, d, "urls"), "d7.example")


@query("schedule_rank", f"{ctes('domains')} SELECT domain, rank() OVER (ORDER BY vtime) AS schedule_rank, count(*) OVER () AS ready FROM domains WHERE pending > 0")
def _(s, d):
    return analytics.schedule_ranks(frame(s, d, "domains")).select("domain", long(F.col("schedule_rank")).alias("schedule_rank"), "ready")


@query("explain_blockers", f"""{ctes('urls', 'hosts', 'domains')} SELECT u.url_key, CAST((CASE WHEN state <> 'PENDING' THEN 1 ELSE 0 END) + (CASE WHEN next_at > 852076800000 THEN 1 ELSE 0 END) + (CASE WHEN next_allowed_at > 852076800000 THEN 1 ELSE 0 END) + (CASE WHEN backoff_until > 852076800000 THEN 1 ELSE 0 END) + (CASE WHEN u.host IN (SELECT host FROM urls WHERE state = 'IN_FLIGHT') THEN 1 ELSE 0 END) + (CASE WHEN d.in_flight >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS reasons
        FROM urls u JOIN hosts h ON u.host = h.host JOIN domains d ON u.domain = d.domain""")
def _(s, d):
    b = analytics.blockers(*parts(s, d, "urls", "hosts", "domains"), NOW)
    return b.select("url_key", F.when(F.get("blockers", F.lit(0)).startswith("FREE"), 0).otherwise(F.size("blockers")).cast("long").alias("reasons"))


@query("explain", None)
def _(s, d):
    return analytics.explain(*parts(s, d, "urls", "hosts", "domains"), NOW).select("url_key", "priority", F.col("recomputed.total").alias("recomputed"), "unexplained", F.round("weight.weight", 6).alias("weight"), F.array_join("blockers", "; ").alias("blockers"))


PRUNE_SQL = f"""{ctes('urls')}, j AS (SELECT *, state = 'PENDING' AND queue = 'PUBLIC' AND source = 'discovered' AND attempts = 0 AND fetched_at IS NULL AND priority < 60 AS ok FROM urls WHERE state = 'PENDING'),
    a AS (SELECT *, ok AND 852076800000 - discovered_at > 31536000000 AS expired FROM j), o AS (SELECT domain, count(*) - count(*) FILTER (WHERE expired) - 60 AS extra FROM a GROUP BY 1),
    b AS (SELECT a.*, extra, row_number() OVER (PARTITION BY a.domain ORDER BY priority, discovered_at DESC, url_key) AS r FROM a JOIN o USING (domain) WHERE ok AND NOT expired AND extra > 0),
    c AS (SELECT url_key, domain, 'EXPIRED' AS reason FROM a WHERE expired UNION ALL SELECT url_key, domain, 'DOMAIN_OVER_CAP' FROM b WHERE r <= extra),
    x AS (SELECT greatest(0, (SELECT count(*) FROM j) - (SELECT count(*) FROM c) - 3000) AS extra),
    g AS (SELECT url_key, domain, row_number() OVER (ORDER BY priority, discovered_at DESC, url_key) AS r FROM a WHERE ok AND NOT expired AND url_key NOT IN (SELECT url_key FROM c)),
    plan AS (SELECT * FROM c UNION ALL SELECT url_key, domain, 'GLOBAL_OVER_CAP' FROM g, x WHERE r <= extra)"""


def plan_of(s, d) -> DataFrame:
    return analytics.prune_plan(frame(s, d, "urls"), NOW, SMALL, expire_ms=365 * scoring.DAY)


@query("prune_plan", f"{PRUNE_SQL} SELECT url_key, domain, reason FROM plan")
def _(s, d):
    return plan_of(s, d)


@query("prune_report", f"{PRUNE_SQL} SELECT 'reason' AS section, reason AS key, count(*) AS n FROM plan GROUP BY 2 UNION ALL (SELECT 'domain', CASE WHEN reason = 'GLOBAL_OVER_CAP' THEN '(all domains)' ELSE domain END AS key, count(*) AS n FROM plan GROUP BY 2 ORDER BY n DESC, key LIMIT 10) UNION ALL SELECT 'total', 'pending_before', count(*) FROM j UNION ALL SELECT 'total', 'candidates', count(*) FROM plan UNION ALL SELECT 'total', 'pending_after', (SELECT count(*) FROM j) - (SELECT count(*) FROM plan) UNION ALL SELECT 'total', 'protected_pending', count(*) FROM j WHERE NOT ok")
def _(s, d):
    return analytics.prune_report(frame(s, d, "urls"), plan_of(s, d))


@query("pruned_frontier", f"{PRUNE_SQL} SELECT url_key FROM urls WHERE url_key NOT IN (SELECT url_key FROM plan)")
def _(s, d):
    return analytics.pruned(frame(s, d, "urls"), plan_of(s, d)).select("url_key")


# ---- demand ----


def ledger(s, d) -> DataFrame:
    k = F.col("c_custkey")
    return frame(s, d, "customer").select(F.sha2(k.cast("string"), 256).alias("qkey"), (F.lit(NOW) - k * 9_000_000).alias("first_seen"), (F.lit(NOW) - k * 8_000_000).alias("last_seen"), (k % 9).alias("times_seen"), F.when(k % 3 != 0, F.lit(NOW) - k * 400_000).alias("last_crawl_at"), (k % 6).alias("crawl_rounds"), (k % 50).alias("last_total"), (k % 7).alias("last_strong"))


LEDGER = "ledger AS (SELECT sha256(CAST(c_custkey AS VARCHAR)) AS qkey, 852076800000 - c_custkey * 8000000 AS last_seen, CASE WHEN c_custkey % 3 <> 0 THEN 852076800000 - c_custkey * 400000 END AS last_crawl_at, c_custkey % 6 AS rounds, c_custkey % 9 AS times_seen, c_custkey AS k FROM customer)"


@query("demand_state", f"""WITH {LEDGER}, w AS (SELECT *, least(86400000, 1800000 * pow(2, least(16, greatest(0, rounds - 1)))) AS rest, 852076800000 - last_crawl_at AS since FROM ledger)
        SELECT qkey, CASE WHEN k % 5 >= 3 THEN 'none' WHEN since < rest THEN 'cooldown' WHEN (SELECT count(*) FROM ledger WHERE last_crawl_at > 852076800000 - 3600000) >= 30 THEN 'rate_limited' ELSE 'discover' END AS state FROM w""")
def _(s, d):
    old = ledger(s, d)
    searches = frame(s, d, "customer").select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("qkey"), F.lit(2).alias("n_terms"), (F.col("c_custkey") % 5).alias("strong"))
    return demand.demand_state(searches, old, 10, NOW).select("qkey", "state")


@query("ledger_trim", f"WITH {LEDGER} SELECT qkey FROM ledger WHERE last_seen >= 852076800000 - 7776000000 ORDER BY last_seen DESC, qkey LIMIT 300")
def _(s, d):
    return demand.trimmed(ledger(s, d), NOW, demand.DemandPolicy(ledger_rows=300)).select("qkey")


@query("ledger_stats", f"WITH {LEDGER} SELECT count(*) AS queries, count(*) FILTER (WHERE rounds > 0) AS explored FROM ledger")
def _(s, d):
    return demand.ledger_stats(ledger(s, d))


@query("ledger_seen", f"WITH {LEDGER}, n AS (SELECT sha256(CAST(o_custkey + 200 AS VARCHAR)) AS qkey, count(*) AS c FROM orders GROUP BY 1) SELECT coalesce(l.qkey, n.qkey) AS qkey, coalesce(times_seen, 0) + coalesce(c, 0) AS times_seen FROM ledger l FULL JOIN n ON l.qkey = n.qkey")
def _(s, d):
    searches = frame(s, d, "orders").select(F.sha2((F.col("o_custkey") + 200).cast("string"), 256).alias("qkey"), (F.lit(NOW) + F.col("o_orderkey")).alias("ts"), F.lit(5).cast("long").alias("total"), F.lit(1).cast("long").alias("strong"))
    return demand.seen(ledger(s, d), searches).select("qkey", "times_seen")


def context(s, d) -> demand.SearchContext:
    u, links = frame(s, d, "urls"), frame(s, d, "links")
    hits = s.createDataFrame([(i, f"p{i}", f"h{i % 40}.d{i % 11}.example") for i in range(1, 8)], "rank int, url_key string, host string")
    return demand.SearchContext(u, links, ["example", "d12", "p1"], hits, 40, "d3.example")


@query("frontier_source", f"{ctes('urls')} SELECT url FROM (SELECT url, priority, CAST(contains(url, 'example') AS INT) + CAST(contains(url, 'd12') AS INT) AS m FROM urls WHERE state = 'PENDING' AND queue = 'PUBLIC') WHERE m > 0 ORDER BY m DESC, priority DESC, url LIMIT 40")
def _(s, d):
    return demand.frontier_source(context(s, d)).select(F.col("raw").alias("url"))


@query("link_source", f"""{ctes('links')}, h AS (SELECT unnest(range(1, 6)) AS hit), r AS (SELECT hit, dst_url, CASE WHEN {DOM.format('dst_host')} <> 'd' || (hit % 11) || '.example' THEN 1 ELSE 0 END AS away, CASE WHEN contains(dst_url, 'example') THEN 1 ELSE 0 END AS named FROM links JOIN h ON src_key = 'p' || hit)
        SELECT dst_url AS url FROM (SELECT *, row_number() OVER (PARTITION BY hit ORDER BY away DESC, named DESC, dst_url) AS n FROM r) WHERE n <= 3""")
def _(s, d):
    return demand.link_source(context(s, d)).select(F.col("raw").alias("url"))


@query("candidate_cap_per_domain", f"""{ctes('urls')}, n AS (SELECT url, domain, row_number() OVER (PARTITION BY domain ORDER BY priority, url) AS r, priority FROM urls WHERE depth = 2), k AS (SELECT url, domain, row_number() OVER (ORDER BY priority, url) AS o FROM n WHERE r <= 2) SELECT url FROM k WHERE o <= 25""")
def _(s, d):
    u = frame(s, d, "urls").filter("depth = 2")
    names = u.select(F.lit(0).alias("source"), F.struct("priority", "url").alias("seq"), F.col("url").alias("raw"))
    return demand.first_per_domain(names, 25).select("url")


@query("discover", None)
def _(s, d):
    sources = [demand.url_source, demand.frontier_source, demand.link_source, demand.template_source(["https://w.example.org/{slug}", "https://{title}.invalid:99/"])]
    return demand.discover(sources, context(s, d))


@query("provider_pick_urls", "SELECT * FROM (VALUES (0, 1, 'https://a.example.com/1'), (0, 2, 'https://b.example.com/2'), (0, 3, 'https://other.net/'), (1, 1, 'https://x.org/'), (2, 1, 'https://y.org/p')) t(answer, turn, url)")
def _(s, d):
    bodies = ['{"results":[{"url":"https://a.example.com/1"},{"url":"https://b.example.com/2"},{"url":"https://c.example.com/3"},{"title":"x"},{"url":"https://other.net"}]}', '{"urls":["https://x.org/","ftp://x.org/","https://x.org/"]}', '["https://y.org/p",{"url":7},null]', "not json"]
    return demand.pick_urls(s.createDataFrame(list(enumerate(bodies)), "answer int, body string"), 10).select("answer", "turn", "url")


@query("query_intent", "SELECT * FROM (VALUES ('d3.example.org', 'url'), ('https://a.org/x', 'url'), ('two words', 'informational'), ('plain', 'informational'), ('10.0.0.1', 'informational')) t(q, intent)")
def _(s, d):
    rows = s.createDataFrame([(q,) for q in ("d3.example.org", "https://a.org/x", "two words", "plain", "10.0.0.1")], "q string")
    return rows.select("q", urls.query_intent(F.col("q")).alias("intent"))


@query("sliding_query_rate", "SELECT event_id, count(*) OVER (PARTITION BY user_id % 50 ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_hour FROM events")
def _(s, d):
    e = frame(s, d, "events").withColumn("micros", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))
    w = Window.partitionBy(F.col("user_id") % 50).orderBy("micros").rangeBetween(-3_600_000_000, 0)
    return e.select("event_id", F.count("*").over(w).alias("in_hour"))

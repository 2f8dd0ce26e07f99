"""Full-text search: postings, BM25, and explainable ranking with variant dedup and host diversity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text, urls
from ..session import bounded_batches

#: BM25 constants, column weights, pool and result sizes, score of a strong result, factor of a host's next result.
K1, B = 1.2, 0.75
WEIGHTS = {"title": 5.0, "description": 2.0, "text": 1.0}
POOL, MAX_RESULTS, FILL_BELOW, STRONG_SCORE, DIVERSITY = 300, 300, 100, 25.0, 0.85


@dataclass(frozen=True)
class Index:
    """postings: term, doc_key, weighted, n; documents: doc_key, length. Both are snapshots that can be stored by term and key."""

    postings: DataFrame
    documents: DataFrame


def fold_ascii_or_accents(column: Column) -> Column:
    """Folding by translation: as the UDF's for Latin letters, but a built-in expression that stays in generated code."""
    return F.lower(F.translate(column, _ACCENTED, _PLAIN))


def _latin() -> tuple[str, str]:
    accented, plain = [], []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        folded = text.fold_text(c)
        if len(folded) == 1 and folded != c:
            accented.append(c)
            plain.append(folded)
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _latin()


def build_index(pages: DataFrame, key: str = "url_key", fold=text.fold) -> Index:
    """Index of pages (key, title, description, text). Term frequencies of a page are counted before anything is shuffled.

    A posting carries its page's length, so that scoring never goes back to the table of documents."""
    bounded_batches(pages.sparkSession)
    fields = {c: text.all_tokens(fold(F.coalesce(F.col(c), F.lit("")))) for c in WEIGHTS}
    rows = pages.select(F.col(key).alias("doc_key"), *[t.alias(c) for c, t in fields.items()])
    length = sum((F.size(c) for c in WEIGHTS), F.lit(0)).cast("long")
    parts = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.col(c).alias("tokens")) for c, w in WEIGHTS.items()]))
    tokens = rows.select("doc_key", length.alias("length"), parts.alias("f")).select("doc_key", "length", "f.w", F.explode("f.tokens").alias("term"))
    postings = tokens.groupBy("term", "doc_key", "length").agg(F.sum("w").alias("weighted"), F.count("*").alias("n"))
    return Index(postings, rows.select("doc_key", length.alias("length")))


def replace_in_index(index: Index, pages: DataFrame, removed: DataFrame, key: str = "url_key") -> Index:
    """The index with pages put in (or replaced) and removed keys (doc_key) taken out: only what changed is tokenised."""
    new = build_index(pages, key)
    gone = removed.select("doc_key").unionByName(pages.select(F.col(key).alias("doc_key"))).distinct()
    keep = lambda old, added: old.join(gone, "doc_key", "left_anti").unionByName(added)
    return Index(keep(index.postings, new.postings), keep(index.documents, new.documents))


def bm25(index: Index, terms: list[str], mode: str = "AND") -> DataFrame:
    """doc_key, fts (negative, lower is better), matched for pages with all terms, or any.

    The terms are literals, so that the filter reaches the scan of stored postings; what is aggregated is their postings only.
    """
    terms = list(dict.fromkeys(terms))
    found = index.postings.filter(F.col("term").isin(*terms)) if terms else index.postings.limit(0)
    totals = index.documents.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    of_term = found.groupBy("term").agg(F.count("*").alias("df"))  # as many rows as the query has terms
    idf = F.ln((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = of_term.crossJoin(totals).select("term", F.when(idf <= 0, 1e-6).otherwise(idf).alias("idf"), "mean")
    hits = found.join(F.broadcast(weights), "term")
    part = F.col("idf") * F.col("weighted") * (K1 + 1) / (F.col("weighted") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    # Doubles add up to what their order gives: the parts, at most as many as a query has terms, are added from the least on.
    parts = F.array_sort(F.collect_list(part))
    scored = hits.groupBy("doc_key").agg((-F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)).alias("fts"), F.count("*").alias("matched"))
    return scored.filter(F.col("matched") == len(terms)) if mode == "AND" else scored


def top(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy("fts", "doc_key").limit(min(max(1, k), 500))


def terms_of(query: str) -> list[str]:
    """A query's terms as the tokenizer of the index sees them, repeats dropped."""
    import regex

    return list(dict.fromkeys(text.fold_text(t[: text.MAX_TERM]).lower() for t in regex.findall(text.TOKEN, query.lower())[: text.MAX_TERMS]))


def plain_search(pages: DataFrame, index: Index, query: str, limit: int = 10, key: str = "url_key") -> DataFrame:
    """url, title, snippet, score: the best pages with all terms. The limit is taken before page texts are joined."""
    terms = terms_of(query)
    best = top(bm25(index, terms), min(max(1, limit), 50))
    hits = pages.join(F.broadcast(best), pages[key] == best["doc_key"])
    return hits.select("url", "title", text.excerpt(F.col("text"), F.array(*map(F.lit, terms))).alias("snippet"), F.col("fts").alias("score"))


def candidates(index: Index, terms: list[str], pool: int = POOL) -> DataFrame:
    """doc_key, fts, every: the best pages with all terms, filled up with the best ones with any if those are few."""
    every = top(bm25(index, terms), pool).withColumn("every", F.lit(True))
    if len(terms) < 2:
        return every
    few = every.agg((F.count("*") < FILL_BELOW).alias("few"))
    some = top(bm25(index, terms, "OR"), pool).withColumn("every", F.lit(False))
    some = some.join(every.select("doc_key"), "doc_key", "left_anti").crossJoin(F.broadcast(few)).filter("few").drop("few")
    return every.unionByName(some)


def inbound_domains(links: DataFrame, domains: DataFrame) -> DataFrame:
    """dst_key, inbound: how many registrable domains other than its own link to a page. domains: host, domain."""
    pairs = links.filter("src_host <> dst_host").select("dst_key", "src_host", "dst_host").distinct()
    src, dst = domains.select(F.col("host").alias("src_host"), F.col("domain").alias("src")), domains.select(F.col("host").alias("dst_host"), F.col("domain").alias("home"))
    return pairs.join(src, "src_host").join(dst, "dst_host").filter("src <> home").groupBy("dst_key").agg(F.count_distinct("src").alias("inbound"))


def share(terms: list[str], found: Column) -> Column:
    wanted = F.array(*map(F.lit, terms))
    return F.size(F.array_intersect(wanted, found)) / float(len(terms))


def score_candidates(pages: DataFrame, chosen: DataFrame, terms: list[str], now_ms: int, inbound: DataFrame | None = None, key: str = "url_key", fold=text.fold) -> DataFrame:
    """Every signal and the score of the chosen pages (at most two pools of rows, so they are broadcast to the pages)."""
    bounded_batches(pages.sparkSession)
    rows = pages.join(F.broadcast(chosen), pages[key] == chosen["doc_key"])
    rows = rows.join(inbound, F.col(key) == inbound["dst_key"], "left") if inbound is not None else rows.withColumn("inbound", F.lit(0).cast("long"))
    host, path = urls.host_of(F.col("url")), text.decoded(urls.path_of(F.col("url")))
    rows = rows.withColumns({"_host": host, "_path": path, "_t": fold(F.col("title")), "_d": fold(F.col("description")), "_b": fold(F.col("text")), "_u": fold(F.concat_ws(" ", host, path)), "inbound": F.coalesce("inbound", F.lit(0))})
    rows = rows.withColumns({f"_{c}s": text.tokens(F.col(f"_{c}")) for c in "tdu"})
    n = float(len(terms))
    any_ = F.array_union(F.array_union(F.col("_ts"), F.col("_us")), F.array_union(F.col("_ds"), text.tokens(F.col("_b"))))
    matched = F.when(F.col("every"), F.lit(len(terms))).otherwise(F.size(F.array_intersect(F.array(*map(F.lit, terms)), any_)))
    phrase = F.contains(text.squash(F.concat_ws(" ", "_t", "_d", "_b")), F.lit(" ".join(terms))) if len(terms) > 1 else F.lit(False)
    x = F.greatest(F.lit(0.0), -F.col("fts"))
    rows = rows.withColumns({"matched_terms": matched, "title_cov": share(terms, F.col("_ts")), "url_cov": share(terms, F.col("_us")), "desc_cov": share(terms, F.col("_ds")), "phrase_match": phrase, "relevance": x / (x + 6.0), "fresh": scoring.freshness(F.col("last_changed_at"), F.lit(now_ms)), "authority": scoring.authority(F.col("inbound"))})
    coverage = F.col("matched_terms") / n
    base = 0.45 * F.col("relevance") + 0.20 * F.col("title_cov") + 0.10 * F.col("url_cov") + 0.05 * F.col("desc_cov") + 0.05 * F.col("phrase_match").cast("double") + 0.15 * coverage
    score = 100.0 * base * coverage * coverage * (1.0 + 0.10 * F.col("fresh")) * (1.0 + 0.15 * F.col("authority")) * F.when(F.col("low_value"), 0.3).otherwise(1.0)
    group = F.coalesce(F.col("canonical_key"), urls.variant_key(F.col("url")))
    return rows.filter("matched_terms > 0").select(
        key, "url", text.title_or_address(F.col("title"), F.col("_host"), F.col("_path")).alias("title"), text.snippet(F.col("text"), F.col("description"), F.array(*map(F.lit, terms))).alias("snippet"), F.col("_host").alias("host"),
        scoring.rounded(score, 3).alias("score"), "matched_terms", F.lit(len(terms)).alias("total_terms"), (F.col("title_cov") > 0).alias("title_match"), (F.col("url_cov") > 0).alias("url_match"), "phrase_match",
        scoring.rounded(F.col("relevance"), 3).alias("relevance"), scoring.rounded(F.col("fresh"), 3).alias("freshness"), F.col("inbound").alias("inbound_hosts"), group.alias("variant_group"), F.col("url").startswith("https:").alias("https"),
    )


def one_per_variant(scored: DataFrame) -> DataFrame:
    """The best-scored page of each group of variants; https first, then the address."""
    w = Window.partitionBy("variant_group").orderBy(F.desc("score"), F.desc("https"), "url")
    return scored.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def diversified(scored: DataFrame) -> DataFrame:
    """The n-th result of a host counts 0.85^(n-1) of its score, rounded again."""
    w = Window.partitionBy("host").orderBy(F.desc("score"), F.desc("https"), "url")
    n = F.row_number().over(w) - 1
    return scored.withColumn("_n", n).withColumn("score", F.when(F.col("_n") == 0, F.col("score")).otherwise(scoring.rounded(F.col("score") * F.pow(F.lit(DIVERSITY), F.col("_n")), 3))).drop("_n")


def page_of(ranked: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    limit, offset = min(max(1, limit), 50), min(max(0, offset), MAX_RESULTS)
    return ranked.orderBy(F.desc("score"), "url").limit(MAX_RESULTS).offset(offset).limit(limit)


def search(pages: DataFrame, index: Index, query: str, now_ms: int, links: DataFrame | None = None, domains: DataFrame | None = None, key: str = "url_key") -> DataFrame:
    """The ranked list of a query (at most MAX_RESULTS rows): scored, one per variant, hosts taking turns."""
    terms = terms_of(query)
    chosen = candidates(index, terms) if terms else index.documents.select("doc_key", F.lit(0.0).alias("fts"), F.lit(True).alias("every")).limit(0)
    inbound = inbound_domains(links.join(F.broadcast(chosen.select(F.col("doc_key").alias("dst_key"))), "dst_key", "left_semi"), domains) if links is not None and domains is not None else None
    ranked = diversified(one_per_variant(score_candidates(pages, chosen, terms or [""], now_ms, inbound, key)))
    return ranked.orderBy(F.desc("score"), "url").limit(MAX_RESULTS)


def counts() -> list[Column]:
    strong = (F.col("matched_terms") == F.col("total_terms")) & (F.col("score") >= STRONG_SCORE)
    return [F.count("*").alias("total"), F.count_if(strong).alias("strong"), F.coalesce(F.max("score"), F.lit(0.0)).alias("best")]


def summary(ranked: DataFrame) -> DataFrame:
    """total, strong and best of a ranked list."""
    return ranked.agg(*counts())


def response(ranked: DataFrame, documents: int, pending: int, limit: int = 10, offset: int = 0) -> DataFrame:
    """One row with the JSON answer of a search: page of hits, counts, and how complete the index is. The list, at most
    MAX_RESULTS rows, is made once for all of them."""
    hit = F.struct("score", "url", "title", "snippet", "host", F.struct("matched_terms", "total_terms", "title_match", "url_match", "phrase_match", "relevance", "freshness", "inbound_hosts").alias("signals"))
    first, size = min(max(0, offset), MAX_RESULTS), min(max(1, limit), 50)
    at = F.struct(F.col("score").isNull().alias("none"), (-F.col("score")).alias("score"), "url")
    listed = F.slice(F.array_sort(F.collect_list(F.struct(at.alias("at"), hit.alias("hit")))), first + 1, size)
    page = F.reverse(F.array_sort(F.transform(listed, lambda x: x["hit"])))
    state = "empty" if documents == 0 else "partial" if pending else "ready"
    return ranked.agg(*counts(), page.alias("hits")).select(F.to_json(F.struct("total", F.lit(offset).alias("offset"), F.lit(limit).alias("limit"), "strong", "best", "hits", F.struct(F.lit(state).alias("state"), F.lit(documents).alias("documents")).alias("index"))).alias("response"))

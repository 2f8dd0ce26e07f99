"""Schemas of the stored tables and of fetch results, and migration of older snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 4


def struct(ddl: str) -> T.StructType:
    """'name type, name type' with the types string, long, int, double, boolean."""
    kinds = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (c.split() for c in ddl.split(","))])


TABLES = {
    "documents": struct("url_key string,url string,final_url string,title string,description string,canonical_url string,language string,text string,content_sha256 string,fetched_at long,http_status int,duplicate_of string,canonical_key string,host string,first_seen_at long,last_changed_at long,change_count long,low_value boolean"),
    "urls": struct("url_key string,url string,host string,domain string,queue string,priority long,state string,generation long,attempts long,next_at long,depth long,discovered_at long,last_outcome string,last_http int,etag string,last_modified string,content_sha256 string,fetched_at long,leased_at long,interval_ms long,change_count long,unchanged_streak long,last_changed_at long,source string,external boolean"),
    "hosts": struct("host string,next_allowed_at long,backoff_until long,failures long"),
    "domains": struct("domain string,family string,first_seen long,leased long,fetched long,useful long,duplicates long,low_value long,errors long,vtime double,yield double,yield_at long,ref_domains long,seed_class string"),
    "links": struct("src_key string,dst_key string,dst_url string,src_host string,dst_host string"),
    "queries": struct("qkey string,first_seen long,last_seen long,times_seen long,last_crawl_at long,crawl_rounds long,last_total long,last_strong long"),
    "crawl_health": struct("domain string,bad_streak long,cooldown_until long"),
    "crawl_retries": struct("url_key string,first_at long"),
}
#: What a column that an older snapshot lacks is filled with; others are null.
DEFAULTS = {"change_count": 0, "unchanged_streak": 0, "low_value": False, "external": False, "yield": 0.5, "vtime": 0.0, "attempts": 0, "generation": 0}

LINK = T.StructType([T.StructField("url", T.StringType()), T.StructField("nofollow", T.BooleanType())])
FETCH_RESULT = T.StructType([
    *struct("idempotency_key string,requested_url string,final_url string,outcome string,http_status int,content_type string,charset string,body_bytes long,body_truncated boolean,content_sha256 string,etag string,last_modified string,redirect_target string,retry_after_sec long,fetched_at_ms long,duration_ms long"),
    T.StructField("robots", struct("verdict string,crawl_delay_sec long")),
    T.StructField("indexing", struct("noindex boolean,nofollow boolean,noarchive boolean")),
    T.StructField("error", struct("code string,retryable boolean")),
    T.StructField("page", T.StructType([*struct("title string,description string,canonical_url string,language string,text string"), T.StructField("links", T.ArrayType(LINK)), T.StructField("links_truncated", T.BooleanType())])),
])
#: Bounds of a result.
MAX_RESULT_BYTES, MAX_RESULT_LINKS, MAX_TEXT_BYTES = 28_000, 100, 10_240


def conform(df: DataFrame, table: str) -> DataFrame:
    """A snapshot in the current schema: missing columns get their defaults, others go; sources of old rows are inferred."""
    schema = TABLES[table]
    missing = {f.name: F.lit(DEFAULTS.get(f.name)).cast(f.dataType) for f in schema if f.name not in df.columns}
    if table == "urls" and "source" in missing:
        missing["source"] = F.when(F.col("queue") == "DEMAND", "demand").when(F.col("depth") == 0, "seed").otherwise("discovered")
    if table == "urls" and "domain" in missing:
        missing["domain"] = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    return df.withColumns(missing).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def valid_result():
    """Whether a fetch result keeps within its bounds and vocabulary."""
    from ..operators.frontier import OUTCOMES

    size = F.octet_length(F.to_json(F.struct("requested_url", "final_url", "outcome", "page")))
    links = F.coalesce(F.size("page.links"), F.lit(0))
    return F.coalesce(F.col("outcome").isin(*OUTCOMES) & F.col("requested_url").isNotNull() & F.col("fetched_at_ms").isNotNull(), F.lit(False)) & (size <= MAX_RESULT_BYTES) & (links <= MAX_RESULT_LINKS) & (F.coalesce(F.octet_length("page.text"), F.lit(0)) <= MAX_TEXT_BYTES)

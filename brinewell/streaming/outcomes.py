"""Structured Streaming over fetch results: hourly counts, replays dropped, domain yield as keyed state, and snapshot updates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scoring import Policy
from ..sources.catalog import Catalog

RETENTION = "24 hours"


def hourly(results: DataFrame) -> DataFrame:
    """hour, queue, answers, fetched of a stream of results (ts, queue, outcome), an hour's once it is over by a day."""
    stamped = results.withWatermark("ts", RETENTION)
    counts = stamped.groupBy(F.window("ts", "1 hour").alias("w"), "queue").agg(F.count("*").alias("answers"), F.count_if(F.col("outcome") == "FETCHED").alias("fetched"))
    return counts.select(F.col("w.start").alias("hour"), "queue", "answers", "fetched")


def sliding(searches: DataFrame, every: str = "1 minute") -> DataFrame:
    """Searches that started a crawl within each hour that ends every minute."""
    return searches.withWatermark("ts", "2 hours").groupBy(F.window("ts", "1 hour", every).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.end").alias("until"), "n")


def once(results: DataFrame) -> DataFrame:
    """The stream without repeats of an idempotency key within a day."""
    return results.withWatermark("ts", RETENTION).dropDuplicatesWithinWatermark(["idempotency_key"])


def yields(samples: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """domain, yield, yield_at, bad_streak, cooldown_until after each batch of samples (domain, ts_ms, seq, kind, affects_health).

    State is four numbers a domain; a batch's samples of a domain are folded in order of time.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        y, at, streak, until = state.get if state.exists else (0.5, 0, 0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts_ms", "seq"])
        for r in rows.itertuples(index=False):
            age = max(0, r.ts_ms - at) if at > 0 else 0
            eff = 0.5 + (y - 0.5) * 0.5 ** (age / policy.yield_half_life_ms)
            useful = r.kind == "useful"
            y, at = min(1.0, max(0.0, eff * 0.9 + 0.1 * useful)), int(r.ts_ms)
            if r.affects_health:
                streak = 0 if useful else min(32, streak + 1)
                until = 0 if streak < 8 else at + int(min(policy.max_backoff_ms, policy.backoff_base_ms * 2 ** (streak - 8)))
        state.update((y, at, streak, until))
        yield pd.DataFrame({"domain": [key[0]], "yield": [y], "yield_at": [at], "bad_streak": [streak], "cooldown_until": [until]})

    return samples.groupBy("domain").applyInPandasWithState(fold, "domain string, yield double, yield_at long, bad_streak long, cooldown_until long", "y double, at long, streak long, until long", "update", GroupStateTimeout.NoTimeout)


def maintain(results: DataFrame, catalog: Catalog, now_ms, checkpoint: str, policy: Policy = Policy(), **trigger) -> StreamingQuery:
    """Applies a stream of fetch results (columns of operators.frontier.transition beside url_key) to the catalog's frontier.

    Each micro-batch is one commit of the catalog. A batch that is run again after a failure changes nothing twice: results
    carry the generation they belong to, and the frontier's has moved on.
    """
    from ..operators import frontier as f

    def apply(batch: DataFrame, _: int) -> None:
        urls = catalog.read("urls")
        mine = batch.dropDuplicates(["url_key"]).withColumnRenamed("generation", "g")
        rows = urls.join(mine, "url_key").filter("generation = g").drop("g")
        if rows.isEmpty():
            return
        now = now_ms()
        catalog.commit({"urls": f.applied(urls, f.transition(rows, now, policy), now)})

    return results.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

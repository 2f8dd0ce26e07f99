"""Scores: URL priority, domain weight, back-off, recrawl intervals, ranking signals, concentration."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000, 86_400_000
#: Fixed values of the crawl.
SEED_PRIORITY, DEMAND_PRIORITY = 60, 100


@dataclass(frozen=True)
class Policy:
    """Crawl policy; a value out of range is an error that names it."""

    max_pending_per_domain: int = 3000
    max_pending_per_family: int = 6000
    max_pending_total: int = 500_000
    domain_concurrency: int = 2
    family_concurrency: int = 4
    saturation_pages: int = 200
    min_weight: float = 0.05
    yield_half_life_ms: int = 7 * DAY
    explore: dict[str, int] = field(default_factory=lambda: {"exploit": 70, "explore": 20, "wildcard": 10})
    preferred_languages: tuple[str, ...] = ("en",)
    language_mode: str = "deprioritize"
    max_internal_links: int = 25
    max_external_links: int = 40
    max_sibling_links: int = 2
    external_bonus: int = 12
    relevance_bonus: int = 6
    tracking_parameters: tuple[str, ...] = ()
    # the frontier's own limits
    host_delay_ms: int = 2000
    max_attempts: int = 5
    backoff_base_ms: int = 60_000
    max_backoff_ms: int = 6 * HOUR
    recrawl_ms: int = 7 * DAY
    recrawl_min_ms: int = 6 * HOUR
    recrawl_max_ms: int = 60 * DAY
    important_recrawl_max_ms: int = 14 * DAY
    gone_recheck_ms: int = 30 * DAY
    failed_recheck_ms: int = 30 * DAY
    stale_lease_ms: int = 300_000
    max_depth: int = 8
    max_urls_per_host: int = 2000
    recrawl_share: float = 0.25

    def __post_init__(self) -> None:
        bounds = {
            "max_pending_per_domain": (1, 10_000_000), "max_pending_per_family": (1, 10_000_000), "max_pending_total": (1, 100_000_000), "domain_concurrency": (1, 64), "family_concurrency": (1, 256),
            "saturation_pages": (1, 10_000_000), "max_internal_links": (0, 100), "max_external_links": (0, 100), "max_sibling_links": (0, 100), "external_bonus": (0, 50), "relevance_bonus": (0, 50),
        }
        for f in fields(self):
            if f.name in bounds:
                low, high = bounds[f.name]
                v = getattr(self, f.name)
                if not isinstance(v, int) or isinstance(v, bool) or not low <= v <= high:
                    raise ValueError(f"{f.name} must be a whole number from {low} to {high}")
        if not 0 < self.min_weight <= 1:
            raise ValueError("min_weight must be above 0 and at most 1")
        if self.yield_half_life_ms < 60_000:
            raise ValueError("yield_half_life_ms must be a minute at least")
        if self.max_pending_per_family < self.max_pending_per_domain:
            raise ValueError("max_pending_per_family must not be below max_pending_per_domain")
        if set(self.explore) != {"exploit", "explore", "wildcard"} or sum(self.explore.values()) != 100 or not all(isinstance(v, int) and 0 <= v <= 100 for v in self.explore.values()):
            raise ValueError("explore shares must total 100")
        if self.language_mode not in ("filter", "deprioritize"):
            raise ValueError("language_mode must be filter or deprioritize")
        if not self.preferred_languages or not all(x == "*" or (x.isascii() and x.isalpha() and x.islower() and 2 <= len(x) <= 3) for x in self.preferred_languages):
            raise ValueError("preferred_languages must be ISO 639 codes or *")


def rounded(x: Column, places: int) -> Column:
    """Half up by floor, as a number, not by its decimal digits."""
    factor = float(10**places)
    return F.floor(x * factor + 0.5).cast("double") / factor


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is."""
    return F.when(b == 0, 0.0).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def discovery_priority(depth: Column) -> Column:
    return F.greatest(F.lit(0), 50 - 6 * depth)


def priority_breakdown(source: Column, depth: Column, external: Column, relevant: Column, hint_allowed: Column, has_query: Column, policy: Policy = Policy()) -> Column:
    """Struct (total, base, external, relevance, language, query); demand and seeds have fixed priorities."""
    fixed = F.when(source == "demand", DEMAND_PRIORITY).when(source == "seed", SEED_PRIORITY)
    only = lambda c: F.when(fixed.isNull(), c).otherwise(0)
    base = F.coalesce(fixed, discovery_priority(depth))
    parts = {"external": only(F.when(external, policy.external_bonus).otherwise(0)), "relevance": only(F.when(relevant, policy.relevance_bonus).otherwise(0)), "language": only(F.when(hint_allowed, 0).otherwise(-20)), "query": only(F.when(has_query, -6).otherwise(0))}
    total = F.coalesce(fixed, F.least(F.lit(99), F.greatest(F.lit(0), base + sum(parts.values()))))
    return F.struct(total.cast("long").alias("total"), base.cast("long").alias("base"), *[c.cast("long").alias(k) for k, c in parts.items()])


def effective_yield(y: Column, yield_at: Column, now: Column, policy: Policy = Policy()) -> Column:
    age = F.when(yield_at > 0, F.greatest(F.lit(0), now - yield_at)).otherwise(0)
    return 0.5 + (y - 0.5) * F.pow(F.lit(0.5), age / float(policy.yield_half_life_ms))


def domain_weight(done: Column, y: Column, yield_at: Column, ref_domains: Column, now: Column, policy: Policy = Policy()) -> Column:
    """Struct (weight, saturation, yield_eff, yield_factor, authority_factor)."""
    saturation = F.greatest(F.lit(policy.min_weight), 1.0 / (1.0 + done / float(policy.saturation_pages)))
    eff = effective_yield(y, yield_at, now, policy)
    factor = 0.25 + 1.5 * eff
    authority = 1.0 + 0.1 * F.least(F.lit(4.0), F.log2(1.0 + ref_domains))
    return F.struct(F.greatest(F.lit(policy.min_weight * 0.25), saturation * factor * authority).alias("weight"), saturation.alias("saturation"), eff.alias("yield_eff"), factor.alias("yield_factor"), authority.alias("authority_factor"))


def backoff(attempts: Column, policy: Policy = Policy()) -> Column:
    power = F.pow(F.lit(2.0), F.least(F.lit(40), F.greatest(F.lit(0), attempts - 1)))
    return F.least(F.lit(float(policy.max_backoff_ms)), policy.backoff_base_ms * power).cast("long")


def domain_cooldown(streak: Column, now: Column, policy: Policy = Policy()) -> Column:
    """Until when a domain rests: eight bad pages in a row begin it."""
    return F.when(streak < 8, F.lit(0).cast("long")).otherwise(now + backoff(streak - 7, policy))


def next_interval(current: Column, changed: Column, referring: Column, policy: Policy = Policy()) -> Column:
    current = F.coalesce(current, F.lit(policy.recrawl_ms).cast("long"))
    cap = F.when(referring >= 5, min(policy.recrawl_max_ms, policy.important_recrawl_max_ms)).otherwise(policy.recrawl_max_ms)
    return F.when(changed.isNull(), current).when(changed, F.greatest(F.lit(policy.recrawl_min_ms), F.floor(current / 2.0 + 0.5))).otherwise(F.least(cap, current * 2)).cast("long")


def demand_cooldown(rounds: Column, base_ms: int = 30 * 60_000, most_ms: int = 24 * HOUR) -> Column:
    return F.least(F.lit(float(most_ms)), base_ms * F.pow(F.lit(2.0), F.least(F.lit(16), F.greatest(F.lit(0), rounds - 1)))).cast("long")


def breaker_delay(level: Column) -> Column:
    """Shared pause after failures of the infrastructure in a row."""
    return F.least(F.lit(60_000.0), 1000 * F.pow(F.lit(2.0), F.greatest(F.lit(0), level - 1))).cast("long")


def freshness(last_changed: Column, now: Column) -> Column:
    return F.exp(-F.greatest(F.lit(0), now - last_changed) / float(DAY) / 180.0)


def authority(linking_domains: Column) -> Column:
    return F.least(F.lit(1.0), F.log2(1.0 + linking_domains) / 4.0)


def slot_class(turn: Column, policy: Policy = Policy()) -> Column:
    slot = (turn * 37) % 100
    e = policy.explore
    return F.when(slot < e["exploit"], "exploit").when(slot < e["exploit"] + e["explore"], "explore").otherwise("wildcard")


def wildcard_start(turn: Column, low: Column, high: Column) -> Column:
    x = turn * F.lit(0.6180339887498949)
    return low + (x - F.floor(x)) * F.greatest(F.lit(0.0), high - low)


def hour_of(ms: Column) -> Column:
    return F.floor(ms / float(HOUR)).cast("long")

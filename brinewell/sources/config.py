"""Configuration from the environment, checked as a whole: an error names the variable, never its value."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from ..functions.domains import parse_families
from ..functions.scoring import Policy
from ..operators.demand import DemandPolicy, check_endpoint

PREFIX = "BRINEWELL_"
#: Variable -> (field, least, most).
WHOLE = {
    "MAX_PENDING_PER_DOMAIN": ("max_pending_per_domain", 1, 10_000_000), "MAX_PENDING_PER_FAMILY": ("max_pending_per_family", 1, 10_000_000), "MAX_PENDING": ("max_pending_total", 1, 100_000_000), "DOMAIN_CONCURRENCY": ("domain_concurrency", 1, 64),
    "FAMILY_CONCURRENCY": ("family_concurrency", 1, 256), "SATURATION_PAGES": ("saturation_pages", 1, 10_000_000), "HOST_DELAY_MS": ("host_delay_ms", 500, 600_000), "MAX_DEPTH": ("max_depth", 0, 64), "MAX_URLS_PER_HOST": ("max_urls_per_host", 1, 10_000_000),
    "MAX_INTERNAL_LINKS": ("max_internal_links", 0, 100), "MAX_EXTERNAL_LINKS": ("max_external_links", 0, 100), "MAX_SIBLING_LINKS": ("max_sibling_links", 0, 100),
}
DEMAND = {"MIN_STRONG": ("min_strong", 0, 50), "QUERIES_PER_HOUR": ("max_queries_per_hour", 0, 10_000), "MAX_PENDING_DEMAND": ("max_pending", 1, 100_000), "PROVIDER_PER_HOUR": ("provider_per_hour", 0, 1000)}


@dataclass(frozen=True)
class Config:
    root: str
    policy: Policy
    demand: DemandPolicy
    families: dict[str, list[str]]
    templates: tuple[str, ...] = ()
    provider: str | None = None


def from_environment(env: Mapping[str, str]) -> Config:
    def get(name: str) -> str | None:
        return env.get(PREFIX + name) or None

    def whole(table: dict) -> dict[str, int]:
        out = {}
        for name, (field, low, high) in table.items():
            if (raw := get(name)) is not None:
                if not raw.isascii() or not raw.isdigit() or not low <= int(raw) <= high:
                    raise ValueError(f"{PREFIX}{name} must be a whole number from {low} to {high}")
                out[field] = int(raw)
        return out

    root = get("ROOT")
    if not root:
        raise ValueError(f"{PREFIX}ROOT is needed")
    listed = lambda name: tuple(x.strip() for x in (get(name) or "").split(",") if x.strip())
    more: dict = {}
    if languages := listed("LANGUAGES"):
        more["preferred_languages"] = tuple(x.lower() for x in languages)
    if mode := get("LANGUAGE_MODE"):
        more["language_mode"] = mode
    if tracking := listed("TRACKING_PARAMETERS"):
        more["tracking_parameters"] = tuple(x.lower() for x in tracking)
    try:
        families = parse_families(get("DOMAIN_FAMILIES") or "")
    except ValueError as e:
        raise ValueError(f"{PREFIX}DOMAIN_FAMILIES: {e}") from None
    provider = get("PROVIDER")
    return Config(root, Policy(**whole(WHOLE), **more), DemandPolicy(**whole(DEMAND)), families, listed("TEMPLATES"), check_endpoint(provider) if provider else None)

"""python -m brinewell.cli analyze|concentration|health|prune|explain|seeds|domain|backup ROOT [ARG]: reports over a catalog."""

from __future__ import annotations

import sys
import time

from .functions import urls
from .operators import analytics, reports
from .session import session
from .sources.catalog import Catalog, backup

USAGE = __doc__


def domains_view(catalog: Catalog):
    """Stored domain state with the counters that follow from the URLs."""
    return catalog.read("domains").join(analytics.domain_counters(catalog.read("urls")), "domain", "left").fillna(0)


def run(command: str, catalog: Catalog, arg: str | None = None, now: int | None = None) -> dict:
    from pyspark.sql import functions as F

    now = now or int(time.time() * 1000)
    frontier, hosts = catalog.read("urls"), catalog.read("hosts")
    if command == "analyze":
        hosts_domains = frontier.select("host", "domain").distinct()
        return analytics.analyze(frontier, catalog.read("links"), hosts_domains, catalog.read("documents"))
    if command == "concentration":
        measures = analytics.concentration(domains_view(catalog))
        return {"concentration": measures, "warnings": analytics.concentration_warnings(measures)}
    if command == "health":
        domains = domains_view(catalog)
        return {"queues": analytics.queue_health(frontier, catalog.read("crawl_retries"), now), "low_yield": analytics.low_yield(domains, catalog.read("crawl_health")), "totals": analytics.yield_totals(domains), "quality": analytics.page_quality(domains)}
    if command in ("prune", "prune-apply"):
        plan = analytics.prune_plan(frontier, now)
        if command == "prune-apply":
            catalog.commit({"urls": analytics.pruned(frontier, plan)})
        return {"prune": analytics.prune_report(frontier, plan)}
    if command == "explain":
        key = urls.url_key(F.lit(urls.parse_crawl_url(arg)[0]))
        one = analytics.explain(frontier, hosts, domains_view(catalog), now)
        return {"explain": one.filter(F.col("url_key") == key)}
    if command == "seeds":
        return {"seeds": analytics.seed_health(frontier, domains_view(catalog), now)}
    if command == "domain":
        return analytics.domain_detail(frontier, hosts, domains_view(catalog), catalog.read("documents"), arg or "", now)
    raise ValueError(USAGE)


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(USAGE)
        return 2
    spark = session("cli")
    catalog = Catalog(spark, args[1])
    if args[0] == "backup":
        print({k: v[0] for k, v in backup(catalog, args[2]).items()})
        return 0
    sections = run(args[0], catalog, args[2] if len(args) > 2 else None)
    print(reports.as_json(sections) if "--json" in args else reports.as_text(sections))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

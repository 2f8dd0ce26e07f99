"""Reports as text and as JSON, from the small frames of the analytics operators."""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame

log = logging.getLogger("brinewell")


def as_dict(sections: dict[str, DataFrame], most: int = 1000) -> dict[str, list[dict]]:
    """Rows of each section; sections are reports, of at most `most` rows."""
    return {name: [r.asDict(recursive=True) for r in df.limit(most).collect()] for name, df in sections.items()}


def as_json(sections: dict[str, DataFrame]) -> str:
    return json.dumps(as_dict(sections), sort_keys=True, default=str)


def as_text(sections: dict[str, DataFrame]) -> str:
    out = []
    for name, rows in as_dict(sections).items():
        out.append(name.replace("_", " "))
        out += ["  " + "  ".join(f"{k}={v}" for k, v in r.items()) for r in rows]
    return "\n".join(out)


def log_counts(name: str, counts: DataFrame) -> None:
    """A JSON line of numbers only: no address, query or credential is ever logged."""
    row = counts.first()
    log.info(json.dumps({"event": name} | {k: v for k, v in (row.asDict() if row else {}).items() if isinstance(v, (int, float))}))


def health(documents: int, pending: int, in_flight: int) -> dict:
    """The state of the index for a health check."""
    return {"ok": True, "index": {"state": "empty" if not documents else "partial" if pending or in_flight else "ready", "documents": documents}, "frontier": {"pending": pending, "in_flight": in_flight}}

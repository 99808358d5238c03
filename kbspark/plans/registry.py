"""All registered queries by name, and the SQL that checks them."""

from __future__ import annotations

from kbspark.plans import activity, changes, content, ingest, parts, quality, retrieval, streams

AREAS = (retrieval, content, ingest, activity, changes, quality, streams, parts)


def all_queries() -> dict:
    return {name: fn for area in AREAS for name, fn in area.QUERIES.items()}


def all_checks() -> dict[str, str]:
    checks = {name: text for area in AREAS for name, text in area.ORACLES.items()}
    checks["retrieve_chunks"] = content.RETRIEVE_CHUNKS
    return checks

"""Registered queries with their oracle SQL, one module per group of operators."""

from __future__ import annotations

from tallyspark.catalog.base import REGISTRY, Query  # noqa: F401


def load() -> dict[str, Query]:
    """All registered queries, in the order of their modules."""
    from tallyspark.catalog import (  # noqa: F401
        normalise,
        extract,
        matching,
        cascades,
        loans,
        summaries,
        health,
        neighbours,
        ingest,
        review,
        maintenance,
        statements,
        streams,
    )

    return REGISTRY

"""End-to-end query definitions."""

from __future__ import annotations

import importlib

from skeinlog.plans.registry import REGISTRY, Query

CATALOGUES = ["search_queries", "summary_queries", "cache_queries", "reading_queries", "window_queries",
              "link_queries", "relation_queries", "lifecycle_queries", "record_queries", "streaming_queries", "extension_queries", "event_queries"]


def load_catalogue() -> dict[str, Query]:
    for name in CATALOGUES:
        importlib.import_module(f"skeinlog.plans.{name}")
    return dict(REGISTRY)

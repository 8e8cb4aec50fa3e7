"""Named queries over the test tables, and their SQL for DuckDB. Each module of this package adds its
own; importing this one gathers them."""

from __future__ import annotations

from tidemark.plans import composite, pixels, registry, rules, series, signals, timeline, transcript, vision
from tidemark.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "composite", "pixels", "registry", "rules", "series", "signals", "timeline", "transcript", "vision"]

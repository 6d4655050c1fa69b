"""All registered queries over the given tables, and their SQL."""

from __future__ import annotations

from .queries import ORACLE_SQL, QUERIES

FLAGSHIP = "index_dry_run"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

"""Registered queries by name, and the DuckDB SQL that each is compared with."""

from __future__ import annotations

from siftwell.queries.registry import ORACLES, QUERIES
from siftwell.queries import corpus, evaluation, retrieval  # noqa: E402,F401  (they register themselves)

__all__ = ["ORACLES", "QUERIES"]

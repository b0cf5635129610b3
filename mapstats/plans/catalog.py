"""All registered queries of the engine itself."""

from __future__ import annotations

from . import audit, chains, diagnostics, etl, io, overlay, partitions, streams  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

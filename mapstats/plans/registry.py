"""Named queries and, where SQL can say the same, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mapstats.sources.views import DUCK_VIEWS, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register f(views) under name; sql goes after the adapter views' common table expressions."""

    def add(f: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            ORACLES[name] = f"WITH RECURSIVE {DUCK_VIEWS}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH RECURSIVE {DUCK_VIEWS} {body}"
        return f

    return add

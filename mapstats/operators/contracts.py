"""Fail-closed contracts: each check is one aggregate, and a broken one raises before any result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks what was promised of it."""


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if twice:
        raise ContractError(f"keys {keys} are not unique")
    return df


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ContractError(f"columns are missing: {missing}")
    return df


def require_complete(df: DataFrame, *columns: str) -> DataFrame:
    """No nulls; no NaN or infinity in floating-point columns."""
    require_columns(df, *columns)
    kinds = dict(df.dtypes)
    bad = [F.count_if(F.col(c).isNull() | ((F.isnan(c) | (F.abs(c) == float("inf"))) if kinds[c] in ("double", "float") else F.lit(False))).alias(c) for c in columns]
    if broken := [c for c, n in df.agg(*bad).first().asDict().items() if n]:
        raise ContractError(f"columns hold nulls or non-finite values: {broken}")
    return df


def require_totals(df: DataFrame, **expected: int) -> DataFrame:
    got = df.agg(*[F.sum(c).alias(c) for c in expected]).first().asDict()
    if wrong := {c: (got[c], n) for c, n in expected.items() if got[c] != n}:
        raise ContractError(f"totals are not conserved: {wrong}")
    return df


def unique_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", left_unique: bool = True) -> DataFrame:
    """An equi-join whose right side, and by default also the left one, must be unique by key."""
    require_unique(right, right_key)
    if left_unique:
        require_unique(left, left_key)
    return left.join(right, left[left_key] == right[right_key], how)

"""Running sums and row numbers over an order, without a task that holds a whole group.

Rows are dealt out by ranges of (group, order); sums inside a range are windows of its own, and those of the
ranges before come from a table of one row a group and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapstats.session import materialised


def cumulative(df: DataFrame, group: list[str], order: list[str], *amounts: str, parts: int | None = None) -> DataFrame:
    """df with before_<amount>: the sum of that column over the rows of the group that come before. Rows that are
    equal in group and order come in any order, each after another."""
    by = [*group, *order]
    ranged = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    placed = materialised(ranged.withColumn("__part", F.spark_partition_id()))
    within = Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*group, "__part").agg(*[F.sum(a).alias(a) for a in amounts])
    zero = lambda c: F.coalesce(c, F.lit(0))
    starts = sums.select(*[F.col(g).alias(f"__g{k}") for k, g in enumerate(group)], F.col("__part").alias("__p"), *[zero(F.sum(a).over(earlier)).alias(f"__{a}") for a in amounts])
    same = F.col("__part") == F.col("__p")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    out = placed.withColumns({f"before_{a}": zero(F.sum(a).over(within)) for a in amounts}).join(starts, same)
    return out.select(*df.columns, *[(F.col(f"before_{a}") + F.col(f"__{a}")).alias(f"before_{a}") for a in amounts])


def numbered(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """df with the number of each row in the order, from 0."""
    return cumulative(df.withColumn(name, F.lit(1).cast("long")), [], list(order), name).drop(name).withColumnRenamed(f"before_{name}", name)


def at_places(counts: DataFrame, group: list[str], wanted: DataFrame, value: str = "value") -> DataFrame:
    """group, name, value: the values at the places (from 0) of wanted(group, name, place) in the sorted column that
    counts(group, value, n, before_n) stands for."""
    w = wanted.select(*[F.col(g).alias(f"__w{k}") for k, g in enumerate(group)], "name", F.col("place").alias("__place"))
    hit: Column = (F.col("before_n") <= F.col("__place")) & (F.col("__place") < F.col("before_n") + F.col("n"))
    for k, g in enumerate(group):
        hit = hit & (F.col(g) == F.col(f"__w{k}"))
    return counts.join(w, hit).select(*group, "name", value)

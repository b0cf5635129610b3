"""Connected components of a table of links by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, written to the shared folder; nothing but two
counts a round reaches the driver. A node with very many links costs rows, not a task: the
minimum is combined before the shuffle and the join is one that Spark splits when skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written


def _least(pairs: DataFrame) -> DataFrame:
    """u, v and m, the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return pairs.join(least, "u")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the least node reachable, for each node in a link. Links are pairs of longs."""
    now = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = _least(large)
        star = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        following = written(star.where("u <> v").distinct())
        mark = tuple(following.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        release([now._mapstats_path])
        now = following
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()

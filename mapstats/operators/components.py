"""Connected components by alternating large and small stars, of many graphs at once.

Every round is a grouped minimum and a join on (keys, node); the number of rounds grows with the logarithm of the
longest path. No task holds a graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapstats.session import materialised


def _least(pairs: DataFrame, keys: list[str], pick: Column) -> DataFrame:
    """keys, u, v of each pair with m, the least of its u's partners and itself."""
    m = pairs.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(m, [*keys, "u"]).where(pick)


def roots(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, root: the least node of the component of each node that an edge (keys, src, dst) has."""
    cols = [*keys, "u", "v"]
    pairs = edges.where("src <> dst").select(*keys, F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))).first()
    pairs = materialised(pairs)
    before = mark(pairs)
    while True:
        both = pairs.unionByName(pairs.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, keys, F.col("v") > F.col("u")).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        # Now u is the larger one, v the smaller.
        large = large.where("u <> v").distinct()
        met = _least(large, keys, F.lit(True))
        small = met.select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select(*keys, "u", F.col("m").alias("v")))
        pairs = materialised(small.where("u <> v").distinct().select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        after = mark(pairs)
        if after == before:
            return pairs.select(*keys, F.col("v").alias("node"), F.col("u").alias("root")).unionByName(pairs.select(*keys, F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        before = after


def district_components(edges: DataFrame, plans: DataFrame, *keys: str) -> DataFrame:
    """keys, district, units, components of every district of plans(keys, node, district); a unit without a neighbour
    in its district is a component of its own."""
    by = [*keys, "district"]
    a = plans.select(*by, F.col("node").alias("src"))
    b = plans.select(*by, F.col("node").alias("dst"))
    inside = edges.join(a, "src").join(b, [*by, "dst"]).select(*by, "src", "dst")
    # In a component of n nodes all but one have another root.
    linked = roots(inside, by).where("node <> root").groupBy(*by).agg(F.count("*").alias("linked"))
    units = plans.groupBy(*by).agg(F.count("*").alias("units"))
    same = reduce(Column.__and__, [F.col(k) == F.col(f"__{k}") for k in by])
    out = units.join(linked.select(*[F.col(k).alias(f"__{k}") for k in by], "linked"), same, "left")
    return out.select(*by, "units", (F.col("units") - F.coalesce("linked", F.lit(0))).alias("components"))

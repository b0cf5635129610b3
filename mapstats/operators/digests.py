"""Digests of tables that do not depend on the order of rows, as hash trees, and what two tables differ in.

A row's digest is that of its fields, written in one canonical form. Rows fall into leaves by their digests (or by those
of their keys); a leaf's digest is that of its rows' digests in order, a branch's that of its leaves, the root's that of
the branches. Leaves are as many as the rows ask for, so none is large. Tables differ only where leaves do, and only
the rows of those are compared.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contracts import ContractError

LEAF = 1024  # rows of a leaf, about
BRANCH = 256  # leaves of a branch
NULL = "\\N"


def canonical(columns: list[str]) -> Column:
    """The fields of a row, by name, as text: lengths keep neighbours apart, nulls differ from every text."""
    field = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit(NULL))
    return F.concat_ws("|", *[field(c) for c in sorted(columns)])


def leaves_for(rows: int) -> int:
    """A power of two."""
    return 1 << max(0, math.ceil(math.log2(max(1, rows / LEAF))))


def leaf_digests(df: DataFrame, keys: list[str], leaves: int) -> DataFrame:
    """leaf, rows, digest of the leaves that have rows; rows are dealt out by their keys."""
    of = F.conv(F.substring(F.sha2(canonical(keys), 256), 1, 12), 16, 10).cast("long") % leaves
    rows = df.select(of.alias("leaf"), F.sha2(canonical(df.columns), 256).alias("d"))
    return rows.groupBy("leaf").agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ""), 256).alias("digest"))


def root(leaf: DataFrame) -> DataFrame:
    """rows, digest of a table, from its leaves."""
    joined = lambda c: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(c, "digest"))), lambda x: F.concat_ws("=", x[c].cast("string"), x["digest"])), ""), 256)
    branch = leaf.groupBy(F.floor(F.col("leaf") / BRANCH).alias("branch")).agg(F.sum("rows").alias("rows"), joined("leaf").alias("digest"))
    return branch.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), joined("branch").alias("digest"))


def differences(a: DataFrame, b: DataFrame, keys: list[str], leaves: int) -> DataFrame:
    """keys, field, a, b: what differs, as text, between two tables of equal columns and unique keys. A row that only one
    has is told by field `row`. Only rows of leaves whose digests differ are joined."""
    fields = [c for c in a.columns if c not in keys]
    left, right = (leaf_digests(x, keys, leaves).select("leaf", F.col("digest").alias(n)) for x, n in ((a, "da"), (b, "db")))
    apart = left.join(right, "leaf", "full").where(~F.col("da").eqNullSafe(F.col("db"))).select("leaf")
    of = F.conv(F.substring(F.sha2(canonical(keys), 256), 1, 12), 16, 10).cast("long") % leaves
    side = lambda x, n: x.withColumn("leaf", of).join(apart, "leaf", "left_semi").select(*[F.col(k).alias(f"{n}_{k}") for k in keys], F.lit(True).alias(f"in_{n}"), F.array(*[F.col(c).cast("string") for c in fields]).cast("array<string>").alias(n))
    same = reduce(Column.__and__, [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys])
    met = side(a, "a").join(side(b, "b"), same, "full")
    one = F.col("in_a").isNull() | F.col("in_b").isNull()
    said = F.when(one, F.array(F.struct(F.lit("row").alias("field"), F.when(F.col("in_a"), "there").alias("a"), F.when(F.col("in_b"), "there").alias("b"))))
    every = F.array(*[F.struct(F.lit(c).alias("field"), F.col("a")[k].alias("a"), F.col("b")[k].alias("b")) for k, c in enumerate(fields)]) if fields else F.array().cast("array<struct<field:string,a:string,b:string>>")
    changed = F.filter(every, lambda x: ~x["a"].eqNullSafe(x["b"]))
    return met.select(*[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in keys], F.explode(said.otherwise(changed)).alias("x")).select(*keys, "x.*")


def provenance(tables: dict[str, tuple[DataFrame, list[str]]], settings: dict) -> DataFrame:
    """name, rows, digest of each table (with its keys), and of the settings as canonical JSON."""
    spark = next(iter(tables.values()))[0].sparkSession
    text = json.dumps(settings, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    out = spark.range(1).select(F.lit("settings").alias("name"), F.lit(len(settings)).cast("long").alias("rows"), F.sha2(F.lit(text), 256).alias("digest"))
    for name, (df, keys) in sorted(tables.items()):
        out = out.unionByName(root(leaf_digests(df, keys, leaves_for(df.count()))).select(F.lit(name).alias("name"), "rows", "digest"))
    return out


def verify(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """Fails closed unless both provenance tables say the same of the same names."""
    a, b = ({r["name"]: (r["rows"], r["digest"]) for r in df.collect()} for df in (recorded, found))  # a row a table
    if wrong := sorted(n for n in a.keys() | b.keys() if a.get(n) != b.get(n)):
        raise ContractError(f"provenance differs: {', '.join(wrong)}")
    return recorded

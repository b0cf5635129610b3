"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every document falls into a block of its source by a hash of its id. Each source's words are
drawn block by block, in a permuted order, pass after pass, until its target is met: that
gives exact block quotas. The tree splits the vector of quotas between the left and the right
half of the output shards, again and again, each time by one multivariate hypergeometric
draw; a shard then takes its quota of each source's drawn blocks in the permuted order, so
that shards are disjoint, and shuffles its documents by a hash. A source's last block is cut:
its documents are taken in hash order up to the target, the last of them in part.

The driver holds one row for each source and one for each block. Blocks number at most
MAX_BLOCKS plus the number of sources, whatever the table's size.

Defined results: a null text has 0 words. Sources are ordered by code point with null as the
last one. Empty sources have target 0. A repeated id falls into the same block each time, and
repeated rows are rows of their own; among equal ones the order in a cut block doesn't matter.
Sizes of 0 everywhere give targets and takings of 0; an empty table gives an empty table.
plan() returns its own columns only; mixed() returns the columns of the documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import masked, words, written

MAX_BLOCKS = 1 << 15
LEAST_BLOCK = 1 << 14  # words
MAX_SHARDS = 4096
SHARD_WORDS = 1 << 20
SEED = 20
CAP = 3.0


def targets(sizes: list[int], weights: list[float], cap: float = CAP) -> list[float]:
    """Shares of the total by weight, none above cap times its size; excess goes to the others by weight."""
    total = float(sum(sizes))
    order = sorted(range(len(sizes)), key=lambda i: (cap * sizes[i] / weights[i], i))
    left, weight, out = total, float(sum(weights)), [0.0] * len(sizes)
    for at, i in enumerate(order):
        if cap * sizes[i] / weights[i] < left / weight:
            out[i] = cap * sizes[i]
            left -= out[i]
            weight -= weights[i]
        else:
            for j in order[at:]:
                out[j] = left * weights[j] / weight
            break
    return out


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas of every shard (shards x sources), summing to those given, by the splitting tree."""
    if shards == 1:
        return quotas[None, :]
    half, total = shards // 2, int(quotas.sum())
    n_left = (total * half + int(rng.integers(shards))) // shards
    left = rng.multivariate_hypergeometric(quotas, n_left, method="marginals")
    return np.concatenate([split_quotas(left, half, rng), split_quotas(quotas - left, shards - half, rng)])


def _hash(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def _draws(sources: list[dict], blocks: dict[int, dict[int, int]], shards: int, seed: int) -> list[tuple]:
    """(source number, block, full draws, words from the cut, shards drawn to) of each block that is drawn."""
    rng = np.random.default_rng(seed)
    lists = []  # of each source, its drawn blocks in order, each with the words it gives (None: all)
    for i, s in enumerate(sources):
        own, drawn, left = blocks.get(i, {}), [], round(s["target"])
        while own and left > 0 and sum(own.values()) > 0:
            for b in rng.permutation(sorted(own)):
                if left <= 0:
                    break
                n = own[int(b)]
                drawn.append((int(b), None if n <= left else left))
                left -= n
        lists.append(drawn)
    quotas = split_quotas(np.array([len(x) for x in lists], dtype=np.int64), shards, rng) if lists else np.zeros((shards, 0), dtype=np.int64)
    out: dict[tuple[int, int], list] = {}
    for i, drawn in enumerate(lists):
        shard_of = np.repeat(np.arange(shards), quotas[:, i])
        for (b, cut), shard in zip(drawn, shard_of, strict=True):
            row = out.setdefault((i, b), [0, 0, [], None])
            if cut is None:
                row[0] += 1
                row[2].append(int(shard))
            else:
                row[1], row[3] = cut, int(shard)
    return [(i, b, *row) for (i, b), row in out.items()]


def _sized(docs: DataFrame, *carried: str) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(*carried, F.col("doc_id").cast("long").alias("__id"), F.col("source").cast("string").alias("__source"), F.size(words(text)).cast("long").alias("__size"), F.xxhash64(text).alias("__text"))


def _planned(sized: DataFrame, rows: DataFrame, shards: int | None, seed: int) -> tuple[DataFrame, int]:
    """rows with __source_size, __target, __full, __shards, __cut and __cut_shard, and the number of
    shards. Sizes come from sized, which has the same documents."""
    spark = rows.sparkSession
    found = sized.groupBy("__source").agg(F.sum("__size").alias("size")).collect()
    found = sorted(found, key=lambda r: (r["__source"] is None, [ord(c) for c in r["__source"] or ""]))
    goal = targets([r["size"] for r in found], [1.0 + k % 3 for k in range(len(found))])
    total = sum(r["size"] for r in found)
    block = max(LEAST_BLOCK, -(-total // MAX_BLOCKS))
    shards = shards or min(MAX_SHARDS, max(1, total // SHARD_WORDS))
    sources = [{"__name": r["__source"], "__source_size": r["size"], "__target": goal[k], "__n": k, "__blocks": max(1, -(-r["size"] // block))} for k, r in enumerate(found)]
    named = spark.createDataFrame(sources, "__name string, __source_size long, __target double, __n int, __blocks long")

    def blocked(df: DataFrame) -> DataFrame:
        df = df.join(F.broadcast(named), df["__source"].eqNullSafe(named["__name"])).drop("__name")
        return df.withColumn("__block", F.pmod(_hash(seed, F.col("__id")), F.col("__blocks")))

    blocks: dict[int, dict[int, int]] = {}
    for r in blocked(sized).groupBy("__n", "__block").agg(F.sum("__size").alias("size")).collect():
        blocks.setdefault(r["__n"], {})[r["__block"]] = r["size"]
    drawn = spark.createDataFrame(_draws([{"target": x} for x in goal], blocks, shards, seed), "__n int, __block long, __full int, __cut_words long, __shards array<int>, __cut_shard int")
    at = blocked(rows).join(F.broadcast(drawn), ["__n", "__block"], "left")  # at most 3 rows a source and block
    at = at.withColumn("__full", F.coalesce("__full", F.lit(0))).withColumn("__shards", F.coalesce("__shards", F.array().cast("array<int>")))
    # Only documents of cut blocks, one block a source, are ordered.
    cut = at.where(F.col("__cut_words") > 0)
    before = F.sum("__size").over(Window.partitionBy("__n").orderBy(_hash(seed + 1, F.col("__id")), "__id", "__text").rowsBetween(Window.unboundedPreceding, -1))
    cut = cut.withColumn("__cut", F.greatest(F.lit(0), F.least("__size", F.col("__cut_words") - F.coalesce(before, F.lit(0)))))
    rest = at.where(F.coalesce(F.col("__cut_words"), F.lit(0)) <= 0).withColumn("__cut", F.lit(0).cast("long"))
    return cut.unionByName(rest), shards


def plan(docs: DataFrame, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, and shards: the output shards that take the document."""
    sized = written(_sized(docs))  # a short row a document; the texts are read once
    got, _ = _planned(sized, sized, shards, seed)
    into = F.concat("__shards", F.when(F.col("__cut") > 0, F.array("__cut_shard")).otherwise(F.array().cast("array<int>")))
    return got.select(
        F.col("__id").alias("doc_id"),
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__full") + F.col("__cut")).cast("long").alias("taken"),
        F.array_join(into.cast("array<string>"), ",").alias("shards"),
    )


def mixed(docs: DataFrame, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """The mix itself: documents repeated as often as they are taken, dealt to their shards, each
    shard shuffled; a document taken in part has that many of its words."""
    kinds = docs.schema
    docs, back = masked(docs, "doc_id", "source", "text", "n_chars")
    got, n = _planned(written(_sized(docs)), _sized(docs, *docs.columns), shards, seed)
    whole = F.transform("__shards", lambda s: F.struct(s.alias("shard"), F.lit(None).cast("long").alias("part")))
    part = F.array(F.struct(F.col("__cut_shard").alias("shard"), F.col("__cut").alias("part")))
    takes = F.concat(whole, F.when(F.col("__cut") > 0, part).otherwise(F.array().cast("array<struct<shard:int,part:bigint>>")))
    rows = got.withColumn("__take", F.explode(takes))
    short = F.coalesce(F.col("__take.part") < F.col("__size"), F.lit(False))
    rows = rows.withColumn("text", F.when(short, F.array_join(F.slice(words(F.col("text")), 1, F.col("__take.part").cast("int")), " ")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(short, F.length("text").cast(kinds["n_chars"].dataType)).otherwise(F.col("n_chars")))
    dealt = rows.repartitionById(n, F.col("__take.shard"))  # a shard a partition
    return back(dealt.sortWithinPartitions("__take.shard", _hash(seed + 2, F.col("__id"), F.col("__take.shard")), "__id", "__text"))

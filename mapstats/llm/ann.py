"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Coarse centroids and codebooks are fitted on a sample of at most SAMPLE_BYTES of vectors (the
least hashes of vec_id). Every vector is then indexed: its list, the code of its residual, and how
far the code is from it. A query probes PROBE_SHARE of all lists, nearest first, and more until it has met
enough rows; in each it ranks the codes by asymmetric distance tables. A distance is off by no more
than its code is, so all rows of a cell are measured exactly on the original vectors, RERANK of them at
first and more in each turn, up to where the codes say that no other can be among the k nearest: of
the lists probed, nothing is lost, however many rows share a code.

Lists are cut into cells of a bounded number of rows, and the queries of a list into bounded
parts, so a list that holds a third of all rows is many tasks. What the driver holds is bounded
by the sample and by MAX_LISTS rows of counts.

Defined results: vectors that are null, zero, or hold null or non-finite components take no
part, nor do those with a null vec_id or a length other than the commonest one (the shorter,
if tied). Rows that share a vec_id count as one, at the nearest of their distances. Ties go to
the smaller vec_id. Fewer candidates than k: all of them. No vectors, or no queries: no rows.
Other columns, of any name, are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import ship, written

SAMPLE = 16_384
SAMPLE_BYTES = 32 << 20
MAX_LISTS = 4096
PARTS = 16
WORDS = 256
LEAST_LISTS = 64
PROBE_SHARE = 0.7  # vectors without clusters need most lists for a recall of 0.9
LEAST_ROWS = 2000
RERANK = 200
CELL = 256
QUERIES = 4096
ROUNDS = 12


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    norm = (centres**2).sum(axis=1)
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = (norm - 2 * x[a : a + 4096] @ centres.T).argmin(axis=1)
    return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds from distinct vectors; an empty cluster stays where it was."""
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


class Index:
    """Centroids and the codebooks of residuals."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.centres = kmeans(sample, lists, rng)
        rest = sample - self.centres[_nearest(sample, self.centres)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(parts, sample.shape[1]))
        self.books = [kmeans(rest[:, c], WORDS, rng, ROUNDS // 2) for c in self.cuts]

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists, codes, and the distances of the vectors from what their codes stand for."""
        own = _nearest(x, self.centres)
        rest = x - self.centres[own]
        codes = np.stack([_nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)
        off = sum(((rest[:, c] - b[codes[:, k]]) ** 2).sum(axis=1) for k, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)))
        return own, codes, np.sqrt(off)

    def distances(self, query: np.ndarray, own: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of one query to the codes of one list, by a table for each part."""
        rest = query - self.centres[own]
        out = np.zeros(len(codes))
        for k, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            out += ((b - rest[c]) ** 2).sum(axis=1)[codes[:, k]]
        return out


def closest(x: np.ndarray, ids: np.ndarray, vectors: np.ndarray, low: np.ndarray, k: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k nearest, each id once, of rows that are no nearer than low."""
    order = np.argsort(low, kind="stable")
    order = order[: np.searchsorted(low[order], np.inf)]
    best, far, limit, at = np.zeros(0, dtype=np.int64), np.zeros(0), np.inf, 0
    while at < len(order) and low[order[at]] <= limit:
        rows = order[at : at + block]
        rows = rows[low[rows] <= limit]
        at, block = at + block, 2 * block
        d = np.sqrt(np.ascontiguousarray(((vectors[rows] - x) ** 2).T).sum(axis=0))
        near = d <= limit
        i, d = np.concatenate([best, ids[rows[near]]]), np.concatenate([far, d[near]])
        ranked = np.lexsort((i, d))
        i, d = i[ranked], d[ranked]
        first = np.sort(np.unique(i, return_index=True)[1])[:k]
        best, far = i[first], d[first]
        if len(far) == k:
            limit = far[-1]
    return best, far


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def valid_vectors(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """vec_id and embedding (doubles) of the rows that take part, their dimension and number."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    sizes = v.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return v, 0, 0
    return v.where(F.size("embedding") == sizes[0]["dim"]), sizes[0]["dim"], sizes[0]["n"]


def fit(v: DataFrame, dim: int, n: int, lists: int | None = None, parts: int = PARTS) -> Index:
    size = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    rows = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).toArrow()
    lists = lists or max(1, min(MAX_LISTS, max(LEAST_LISTS, round(n**0.5 / 8)), n // 4, size // 16))
    return Index(_matrix(rows.column("embedding"), dim), lists, parts)


def search(vectors: DataFrame, is_query: Column, k: int = 10, probes: float = PROBE_SHARE, rerank: int = RERANK, lists: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of each query's k nearest found."""
    spark = vectors.sparkSession
    ship(spark)
    v, dim, n = valid_vectors(vectors)
    shape = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], shape)
    kind = vectors.schema["embedding"].dataType
    number = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    shared = spark.sparkContext.broadcast(fit(v, dim, n, lists))  # bounded by the sample

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                own, codes, off = shared.value.codes(_matrix(b.column("embedding"), dim))
                vector = b.column("embedding").cast(pa.list_(pa.float32() if number == "float" else pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off), vector], names=["vec_id", "list", "code", "off", "embedding"])

    index = written(v.mapInArrow(code, f"vec_id long, list int, code binary, off double, embedding array<{number}>"))
    held = {r["list"]: r["n"] for r in index.groupBy("list").agg(F.count("*").alias("n")).collect()}
    width = len(shared.value.centres)
    rows = np.array([held.get(i, 0) for i in range(width)])
    cell = max(CELL, 2 * n // width)
    cells = -(-rows // cell)
    enough = max(LEAST_ROWS, 4 * rerank)

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b.column("embedding"), dim)
            order = np.argsort(((shared.value.centres**2).sum(axis=1) - 2 * x @ shared.value.centres.T), axis=1, kind="stable")
            met = np.cumsum(rows[order], axis=1) - rows[order]
            keep = (rows[order] > 0) & ((np.arange(width) < probes * width) | (met < enough))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array([o[f].astype(np.int32) for o, f in zip(order, keep, strict=True)], pa.list_(pa.int32()))], names=["query_id", "vector", "lists"])

    queries = written(v.where(is_query).mapInArrow(probe, "query_id long, vector array<double>, lists array<int>"))
    asked = queries.select("query_id", "vector", F.explode("lists").alias("list"))
    counts = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}
    parts = np.array([-(-counts.get(i, 0) // QUERIES) for i in range(width)])

    named = spark.createDataFrame([(i, int(cells[i]), int(max(1, parts[i]))) for i in range(width) if rows[i]], "list int, cells int, parts int")
    own_cell = F.pmod(F.xxhash64("vec_id"), F.col("cells")).cast("int")
    own_part = F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")
    right = index.join(F.broadcast(named), "list").withColumn("cell", own_cell).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("list", "cell", "part", "vec_id", "code", "off", "embedding")
    left = asked.join(F.broadcast(named), "list").withColumn("part", own_part).withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).select("list", "cell", "part", "query_id", "vector")

    def rank(q: pa.Table, t: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if len(q) and len(t):
            own = q.column("list")[0].as_py()
            ids = t.column("vec_id").to_numpy()
            codes = np.frombuffer(b"".join(t.column("code").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
            off, vectors = t.column("off").to_numpy(), _matrix(t.column("embedding"), dim)
            for query, x in zip(q.column("query_id").to_pylist(), _matrix(q.column("vector"), dim), strict=True):
                d = np.sqrt(shared.value.distances(x, own, codes))
                low = d - off - 1e-9 * (d + off) - 1e-12 * np.sqrt((x**2).sum())  # and what rounding may add
                low[ids == query] = np.inf
                best, far = closest(x, ids, vectors, low, k, rerank)
                for c, value in zip(out, (np.full(len(best), query), best, far), strict=True):
                    c.append(value)
        flat = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"query_id": pa.array(flat[0].astype(np.int64)), "vec_id": pa.array(flat[1].astype(np.int64)), "score": pa.array(flat[2].astype(np.float64))})

    keys = ("list", "cell", "part")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rank, "query_id long, vec_id long, score double")
    scored = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    top = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "vec_id", "score")

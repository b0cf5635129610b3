"""Importance resampling towards a target corpus by hashed word features, in two Arrow passes.

First pass: each partition counts its hashed features with np.bincount in one vector of `buckets` numbers, and
treeReduce adds the vectors up, for the corpus and for the target. The gain of a bucket is the logarithm of its
share in the target over that in the corpus. Second pass: gains, a vector of `buckets` numbers, are broadcast,
gathered for all features of a batch, and summed by document with the weights of np.bincount. Documents are then
drawn without replacement by the highest of weight plus Gumbel noise, which depends on doc_id and a seed only.

A null text has no words. Words are runs of ASCII letters and digits and of anything beyond ASCII, after A-Z are
lower-cased. A null doc_id draws its noise as an empty one. Rows that are equal stay rows of their own and are
ranked one after the other; ties in score go to the smaller doc_id, null last. Empty tables give no rows;
without a target all gains follow from the corpus alone. Other columns are not read. Long texts are hashed in
slices, so memory does not grow with a text's number of words.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, sliced, tidy, written

BUCKETS = 10_000
#: Bytes of a text that are cut into words at once, and texts that are held at once.
SLICE = 1 << 22
TEXTS = 256
#: Bytes of words stay, lower-cased; all others part words.
_CLEAN = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
RANKED = "doc_id long, n_features long, weight long, score long"


def _slices(text: bytes):
    """Cleaned text in slices that end between words."""
    text = text.translate(_CLEAN)
    start = 0
    while len(text) - start > SLICE:
        end = text.rfind(b" ", start, start + SLICE)
        end = end if end > start else text.find(b" ", start + SLICE)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def features(text: bytes, ngram: int, buckets: int):
    """Arrays of the buckets of all runs of 1 to ngram words of a text, slice by slice."""
    before: list[bytes] = []
    for piece in _slices(text):
        words = piece.split()
        hashed = list(map(zlib.crc32, words))
        run = before + words
        for n in range(2, ngram + 1):
            first = max(0, len(before) - n + 1)
            hashed += [zlib.crc32(b" ".join(run[k : k + n])) for k in range(first, len(run) - n + 1)]
        before = run[max(0, len(run) - ngram + 1) :] if ngram > 1 else []
        yield np.array(hashed, dtype=np.uint32) % np.uint32(buckets), len(words)


def _texts(column: pa.Array) -> list[bytes]:
    return [(x or "").encode() for x in column.to_pylist()]


def bucket_counts(texts: DataFrame, ngram: int, buckets: int) -> np.ndarray:
    """How many features of a column of texts fall in each bucket."""

    @tidy
    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in sliced([batch], TEXTS):
                for text in _texts(part.column(0)):
                    for hashed, _ in features(text, ngram, buckets):
                        total += np.bincount(hashed, minlength=buckets)
        yield pa.RecordBatch.from_pydict({"counts": pa.array([total.tobytes()], pa.binary())})

    vectors = texts.mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], dtype=np.int64))
    n = vectors.getNumPartitions()
    # Every level adds up to 32 vectors, so that no task, and not the driver, adds up many.
    return vectors.treeReduce(np.add, max(2, math.ceil(math.log(max(n, 2), 32)))) if n else np.zeros(buckets, dtype=np.int64)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket."""
    more, less = float(corpus.sum()) + len(corpus), float(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log((t + 1.0) * more / ((s + 1.0) * less))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Floored thousandfold Gumbel noise of a document."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, ngram: int, seed: int) -> DataFrame:
    """doc_id, n_features, n_words, weight, score."""
    ship(docs.sparkSession)
    buckets, shared = len(gain), docs.sparkSession.sparkContext.broadcast(gain.astype(np.float64))

    @tidy
    def score(batches):
        g = shared.value
        for batch in batches:
            for part in sliced([batch], TEXTS):
                ids, n = part.column(0).to_pylist(), part.num_rows
                sums, counts, words = np.zeros(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
                held, owner = [], []

                def add():
                    at, of = np.concatenate(held), np.repeat([k for k, _ in owner], [m for _, m in owner])
                    sums[:] += np.bincount(of, weights=g[at], minlength=n)
                    counts[:] += np.bincount(of, minlength=n)
                    held.clear()
                    owner.clear()

                for k, text in enumerate(_texts(part.column(1))):
                    for hashed, m in features(text, ngram, buckets):
                        held.append(hashed)
                        owner.append((k, len(hashed)))
                        words[k] += m
                        if len(hashed) > SLICE // 8:
                            add()
                if held:
                    add()
                # Sums of whole numbers are exact in doubles up to 2^53.
                weight = sums.astype(np.int64) // np.maximum(counts, 1)
                total = weight + np.array([noise(i, seed) for i in ids], dtype=np.int64).reshape(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, (counts, words, weight, total))], ["doc_id", "n_features", "n_words", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, n_features long, n_words long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, ngram: int = 1, buckets: int = BUCKETS, seed: int = 2024, percent: int = 10, least_words: int = 20) -> DataFrame:
    """Every document: doc_id, n_features, weight, score, rank. Of the N with at least `least_words` words the
    floor(percent N / 100) of the highest scores are drawn and ranked from 1; others have no rank.

    Ranks come from a sort by ranges and the numbers of rows of the ranges before, so no task sorts all rows."""
    ship(docs.sparkSession)
    gain = gains(bucket_counts(docs.select("text"), ngram, buckets), bucket_counts(target.select("text"), ngram, buckets))
    scored = scores(docs, gain, ngram, seed).withColumn("open", F.col("n_words") >= least_words)
    by = [F.col("open").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    scored = scored.withColumn("tie", F.monotonically_increasing_id())
    placed = written(scored.repartitionByRange(*by, "tie").sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    ranges = sorted(map(tuple, placed.groupBy(part.alias("part")).agg(F.count("*"), F.count_if("open")).collect()))
    before, total = {}, 0
    for p, n, _ in ranges:
        before[p] = total
        total += n
    drawn = percent * sum(k for _, _, k in ranges) // 100
    # A number for each range: as many as the session has shuffle partitions.
    offsets = docs.sparkSession.createDataFrame(list(before.items()), "part long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = placed.join(F.broadcast(offsets), part == F.col("part"))
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("open") & (rank <= drawn), rank).alias("rank"))

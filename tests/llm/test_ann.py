import numpy as np
import pytest
from pyspark.sql import functions as F

from mapstats.llm import ann


def brute(rows, k, every):
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in ok:
        if q % every == 0:
            out[q] = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in ok if i != q)[:k]
    return out


def rows(n, dim=16, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim))
    x = (centres[r.integers(12, size=n)] + 0.3 * r.normal(size=(n, dim))).astype(np.float32)
    x[: n // 3] = x[:1]
    return [(int(i), [float(v) for v in x[i]]) for i in range(n)]


def found(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_ties(spark):
    data = rows(3000)
    df = spark.createDataFrame([(i, v, 0.5) for i, v in data], "vec_id long, embedding array<float>, score double")
    got, want = found(ann.search(df, F.col("vec_id") % 20 == 0)), brute(data, 10, 20)
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    for q in want:
        assert len(got[q]) == 10 and got[q] == sorted(got[q])
        if q < 1000:  # all of the nearest are equal to the query: the smallest ids win
            assert [i for _, i in got[q]] == [i for i in range(11) if i != q][:10]


def test_near_copies_that_share_codes(spark):
    """However few rows are measured at once, all lists probed give the nearest of all."""
    r = np.random.default_rng(5)
    x = r.normal(size=(2000, 64))
    x[:800] = x[0] + 0.001 * r.normal(size=(800, 64))
    data = [(i, np.float32(v).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got, want = found(ann.search(df, F.col("vec_id") % 100 == 0, probes=1.0, rerank=10)), brute(data, 10, 100)
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}


def test_closest_equals_brute_force():
    r = np.random.default_rng(6)
    for k, block in ((1, 1), (5, 3), (10, 200)):
        vectors = r.integers(0, 3, size=(150, 4)).astype(float)
        ids, x = r.integers(0, 60, size=150), r.normal(size=4)
        d = np.sqrt(((vectors - x) ** 2).sum(axis=1))
        best, far = ann.closest(x, ids, vectors, d - 0.5 * r.random(150), k, block)
        least = {}
        for i, y in zip(ids.tolist(), d.tolist(), strict=True):
            least[i] = min(y, least.get(i, y))
        want = sorted((round(y, 9), i) for i, y in least.items())[:k]
        assert [(round(y, 9), i) for i, y in zip(best.tolist(), far.tolist(), strict=True)] == want


@pytest.mark.parametrize("n", [0, 1, 2, 7])
def test_small_and_bad_vectors(spark, n):
    data = rows(n) + [(100, None), (None, [1.0] * 16), (102, [0.0] * 16), (103, [float("nan")] * 16), (104, [None] + [1.0] * 15), (105, [float("inf")] * 16), (106, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = found(ann.search(df, F.col("vec_id") % 2 == 0))
    want = {q: v for q, v in brute(data, 10, 2).items() if v}
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    for q in want:
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in want[q]])

import numpy as np
import pytest

from mapstats.llm import mixing as M


def reshare(sizes, weights, cap=3.0):
    """By rounds, as the contract puts it."""
    total, fixed = float(sum(sizes)), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        if not free:
            return [fixed[i] for i in range(len(sizes))]
        left, w = total - sum(fixed.values()), sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > cap * sizes[i]]
        if not over:
            return [fixed.get(i, left * weights[i] / w) for i in range(len(sizes))]
        fixed |= {i: cap * sizes[i] for i in over}


def test_targets():
    rng = np.random.default_rng(1)
    for _ in range(200):
        sizes = [int(x) for x in rng.integers(0, 1000, rng.integers(1, 9))]
        weights = [1.0 + k % 3 for k in range(len(sizes))]
        assert M.targets(sizes, weights) == pytest.approx(reshare(sizes, weights))
    assert M.targets([0, 0], [1.0, 2.0]) == [0, 0]


def test_tree_keeps_quotas():
    quotas = np.array([5, 0, 17, 100])
    got = M.split_quotas(quotas, 7, np.random.default_rng(2))
    assert got.shape == (7, 4) and (got.sum(0) == quotas).all() and (got >= 0).all()
    assert got.sum(1).max() - got.sum(1).min() <= 3


def rows():
    out = [(i, "w " * (1 + i % 50), "big", 0) for i in range(900)]
    out += [(1000 + i, "w " * 30, "a", 0) for i in range(20)] + [(2000 + i, "v " * 10, None, 0) for i in range(40)]
    return out + [(3000, None, "zero", 0), (None, "x y", "b", 0), (7, "same", "b", 0), (7, "same", "b", 0)]


def test_plan_and_mix(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, size int")
    got = M.plan(docs, shards=4).collect()
    assert len(got) == len(rows())
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault((r.source_size, r.target), []).append(r)
    assert sum(k[0] for k in by) == sum(len((t or "").split()) for _, t, _, _ in rows())
    for (_, target), rs in by.items():
        assert abs(sum(r.taken for r in rs) - target) <= 1
    assert sorted(map(str, got)) == sorted(map(str, M.plan(docs.repartition(3), shards=4).collect()))
    mix = M.mixed(docs, shards=4)
    assert mix.schema == docs.schema
    taken = {}
    for r in mix.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
    want = {}
    for r in got:
        if r.taken:
            want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert taken == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.plan(docs).count() == 0 and M.mixed(docs).count() == 0
    clash = spark.createDataFrame([(1, "a b", "s", "x", 5)], "doc_id long, text string, source string, __take string, __full int")
    assert [tuple(r) for r in M.mixed(clash).collect()] == [(1, "a b", "s", "x", 5)]
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.taken, r.target) for r in M.plan(docs).collect()] == [(0, 0, 0.0)] * 2

"""All pairs of saved states, choices among them, and their contiguity, against brute force; none writes units times states."""

import itertools

import numpy as np
import pytest

from mapstats.operators import assignments as A
from mapstats.operators import partition as P
from mapstats.plans.catalog import QUERIES
from mapstats.sources import views

from .test_partitions import distance

SF = "/root/testdata/sf0.001"


def labels(node, seed, step):
    return (node // (step // 10 + 1) + node * seed) % 5 + 1


def saved(spark, count):
    keys = sorted((k % 3, 10 * (k // 3) + 9) for k in range(count))
    rows = [(i, s, t) for i, (s, t) in enumerate(keys, 1)]
    return rows, spark.createDataFrame(rows, "i long, seed int, step long")


def people(kind, nodes):
    rng = np.random.default_rng(5)
    return rng.integers(0, {"small": 90, "large": 1 << 40}[kind], len(nodes))


@pytest.mark.parametrize(("tile", "chunk", "kind"), [(128, 1 << 17, "small"), (3, 16, "small"), (4, 7, "large"), (1, 64, "large")])
def test_distances_of_all_pairs(spark, monkeypatch, tile, chunk, kind):
    monkeypatch.setattr(A, "TILE", tile)
    monkeypatch.setattr(A, "CHUNK", chunk)
    nodes = np.arange(3, 63)
    w = people(kind, nodes)
    rows, states = saved(spark, 9)
    units = spark.createDataFrame(list(zip(nodes.tolist(), w.tolist(), strict=True)), "node long, totpop long")
    got = [tuple(r) for r in A.pair_distances(units, states, labels, 5).collect()]
    plans = {i: labels(nodes, s, t).tolist() for i, s, t in rows}
    assert sorted(r[:2] for r in got) == list(itertools.combinations(range(1, 10), 2))
    for i, j, u, p in got:
        assert u == pytest.approx(distance(plans[i], plans[j], [1] * len(nodes)), abs=1e-9)
        assert p == pytest.approx(distance(plans[i], plans[j], w.tolist()), abs=1e-9)
    pairs = spark.createDataFrame([(i, j, round(p, 7)) for i, j, _, p in got], "i long, j long, pop_vi double")
    want = [tuple(r) for r in P.maximin(pairs, 5, 2).orderBy("rank").collect()]
    assert [tuple(r) for r in A.maximin(units, states, labels, 5, 5, 7, 2).orderBy("rank").collect()] == want


def test_equal_states_cannot_be_chosen(spark):
    units = spark.createDataFrame([(1, 4), (2, 5)], "node long, totpop long")
    with pytest.raises(ValueError):
        A.maximin(units, saved(spark, 4)[1], lambda node, seed, step: node, 5, 3, 7)


@pytest.mark.parametrize(("chunk", "blocks", "seed"), [(1 << 17, 48, 1), (16, 3, 2), (7, 1, 3), (1, 2, 4)])
def test_components_of_saved_states(spark, monkeypatch, chunk, blocks, seed):
    monkeypatch.setattr(A, "CHUNK", chunk)
    monkeypatch.setattr(A, "BLOCKS", blocks)
    rng = np.random.default_rng(seed)
    nodes = sorted(rng.choice(90, 70, replace=False).tolist())
    edges = [tuple(e) for e in rng.integers(0, 90, (120, 2)).tolist()] + [(k + 1, k) for k in range(40, 80)]  # loops, repeats, units that are not there
    rows, states = saved(spark, 9)
    shape = lambda node, seed, step: np.where(node < 40, labels(node, seed, step), 1 + node // 60)
    want = {}
    for _, s, t in rows:
        at = dict(zip(nodes, shape(np.array(nodes), s, t).tolist(), strict=True))
        root = {n: n for n in nodes}
        for _ in nodes:
            for a, b in edges:
                if a in at and b in at and at[a] == at[b]:
                    root[a] = root[b] = min(root[a], root[b])
        for d in set(at.values()):
            want[s, t, d] = sum(at[n] == d and root[n] == n for n in nodes)
    units = spark.createDataFrame([(n,) for n in nodes], "node long")
    got = A.components(units, spark.createDataFrame(edges, "src long, dst long"), states, shape, 5).collect()
    assert {(r.seed, r.step, r.district): r.components for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("name", ["agg_17_distance_quartiles", "agg_26_long_lags", "par_05_all_pairs", "par_08_maximin", "par_09_validation"])
def test_no_table_of_all_units_of_all_states(spark, monkeypatch, name):
    def refuse(_):
        raise AssertionError("units times states were written")

    monkeypatch.setattr(views, "_ASSIGN", {})
    monkeypatch.setattr(views, "materialised", refuse)
    assert QUERIES[name](spark, SF).count() > 0


def shuffled(plan):
    """Rows that the shuffles of a finished plan wrote."""
    name, own = plan.getClass().getSimpleName(), 0
    if name == "AdaptiveSparkPlanExec":
        return shuffled(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return shuffled(plan.plan())
    if name == "ShuffleExchangeExec":
        own = plan.metrics().apply("shuffleRecordsWritten").value()
    children = plan.children()
    return own + sum(shuffled(children.apply(k)) for k in range(children.size()))


def test_a_task_of_pairs_is_sent_the_units_once(spark, monkeypatch):
    """Units were sent once a pair of tiles, and the pairs shuffled to meet what is said of their states."""
    monkeypatch.setattr(A, "TILE", 1)
    monkeypatch.setattr(A, "CHUNK", 16)
    monkeypatch.setattr(A, "TASKS", 3, raising=False)
    units = spark.createDataFrame([(k, k % 7) for k in range(64)], "node long, totpop long")
    rows, states = saved(spark, 20)
    starts = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "seed int, start string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a list of states that is large
    try:
        pairs = A.all_pairs(units, states, starts, labels, 5, 20)
        got = pairs.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(got) == 190 and {(r.i, r.j): r.same_start for r in got} == {(a[0], b[0]): a[1] % 2 == b[1] % 2 for a, b in itertools.combinations(rows, 2)}
    assert shuffled(pairs._jdf.queryExecution().executedPlan()) <= 3 * (4 + 2)


def folding(node, seed, step):
    return (node // (step * 40 + 3) + node % (seed + 2)) % 5 + 1


folding.folds = lambda seed, step: (step * 40 + 3, seed + 2)


def test_choices_take_runs_of_labels(spark, monkeypatch):
    """As all units give them, and without the labels of every unit of every state."""
    nodes = np.arange(5, 905)
    units = spark.createDataFrame(list(zip(nodes.tolist(), people("small", nodes).tolist(), strict=True)), "node long, totpop long")
    _, states = saved(spark, 9)
    monkeypatch.setattr(A, "BLOCKS", 1)
    want = A.distances_between(units, states, lambda node, seed, step: folding(node, seed, step), 5, 1, 9).orderBy("i").collect()
    seen = spark.sparkContext.accumulator(0)

    def counted(node, seed, step):
        seen.add(len(node))
        return folding(node, seed, step)

    counted.folds = folding.folds
    got = A.distances_between(units, states, counted, 5, 1, 9).orderBy("i").collect()
    assert got == want and len(got) == 9
    assert seen.value < 9 * len(nodes) / 2


@pytest.mark.parametrize(("name", "most"), [("j_09_pairs", 0.3), ("flt_11_long_lag_pairs", 0.5)])
def test_pairs_of_states_are_written_small(spark, tmp_path, name, most):
    """Every pair once, in an order that files of columns take in little room."""
    pairs = QUERIES[name](spark, "/root/testdata/sf0.1")
    pairs.write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out"))
    n = rows.count()
    assert rows.select("i", "j").distinct().count() == n
    if name == "j_09_pairs":
        last = rows.agg({"j": "max"}).first()[0]
        assert n == last * (last - 1) // 2
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < most * n

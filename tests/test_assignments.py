"""Sums over saved states against brute force, and that no table of all units of all states is made for them."""

import math
from collections import Counter

import numpy as np
import pytest

from mapstats.operators import assignments as A
from mapstats.plans.catalog import QUERIES
from mapstats.sources import views

SF = "/root/testdata/sf0.001"


def labels(node, seed, step):
    return (node // (step + 1) + node * seed) % 4 + 1


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(3)
    nodes = sorted(rng.choice(400, 150, replace=False).tolist())
    rows = [(n, [None, "000", "001", "002"][int(rng.integers(0, 4))], int(rng.integers(0, 10**9)), int(rng.integers(0, 50)), int(rng.integers(1, 5))) for n in nodes]
    states = [("x", s, t) for s in (0, 1, 2) for t in (9, 19, 29, 39)]
    return rows, states, spark.createDataFrame(rows, "node long, county string, totpop long, dem long, y int"), spark.createDataFrame(states, "experiment string, seed int, step long")


@pytest.mark.parametrize(("chunk", "blocks"), [(1 << 17, 48), (64, 3), (1, 1)])
def test_tables_against_brute_force(small, monkeypatch, chunk, blocks):
    monkeypatch.setattr(A, "CHUNK", chunk)
    monkeypatch.setattr(A, "BLOCKS", blocks)
    rows, states, units, saved = small
    want, kinds, tables, mass = Counter(), {}, {}, Counter()
    for _, s, t in states:
        for n, c, w, d, y in rows:
            x = labels(n, s, t)
            want[s, t, x] += np.array([1, w, d], dtype=object)
            kinds.setdefault((s, t, c), set()).add(x)
            tables.setdefault((s, t, c), Counter())[x, y] += w
            mass[s, c] += w if x <= 2 else 0
    got = A.district_sums(units, saved, labels, 4, "totpop", "dem").collect()
    assert {(r.seed, r.step, r.district): [r.units, r.totpop, r.dem] for r in got} == {k: list(v) for k, v in want.items()}
    counties = ["000", "001", "002", None]
    assert {(r.seed, r.step, r.county): r.x for r in A.county_kinds(units, saved, labels, 4, counties).collect()} == {k: len(v) for k, v in kinds.items()}
    assert {(r.seed, r.county): r.x for r in A.county_mass(units, saved, labels, 4, counties, 2).collect()} == mass

    def vi(t):
        total = sum(t.values())
        h = lambda m: -sum(v / total * math.log2(v / total) for v in m.values() if v)
        x, y = Counter(), Counter()
        for (a, b), v in t.items():
            x[a] += v
            y[b] += v
        return 2 * h(t) - h(x) - h(y)

    got = {(r.seed, r.step, r.county): r.pop_vi for r in A.distances_to(units, saved, labels, 4, counties).collect()}
    assert got.keys() == tables.keys() and all(got[k] == pytest.approx(vi(t), abs=1e-7) for k, t in tables.items())


@pytest.mark.parametrize("name", "agg_22_election_range agg_24_county_drift agg_25_seed_range agg_31_contrasts int_06_final_checkpoint j_10_leave_one_out j_11_trace_checkpoint met_01_seats met_02_efficiency_gap met_03_mean_median met_04_population met_07_uniform_swing met_10_least_margin met_11_seat_vectors met_13_winner par_04_similarity par_06_to_reference par_07_county_vi snk_06_checkpoint src_09_checkpoints win_11_consecutive_plans win_11_matched_plans".split())
def test_no_table_of_all_units_of_all_states(spark, monkeypatch, name):
    def refuse(_):
        raise AssertionError("units times states were written")

    monkeypatch.setattr(views, "_ASSIGN", {})
    monkeypatch.setattr(views, "materialised", refuse)
    assert QUERIES[name](spark, SF).count() > 0


def test_checkpoints_come_back_whole(small, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "CHUNK", 64)
    rows, states, units, saved = small
    A.checkpoints(units, saved, labels).write.partitionBy("experiment", "seed").parquet(str(tmp_path / "c"))
    got = A.read_checkpoints(spark.read.schema(A.CHECKPOINT).parquet(str(tmp_path / "c"))).collect()
    assert {(r.seed, r.step): (r.units, r.labels) for r in got} == {(s, t): (len(rows), sum(labels(r[0], s, t) for r in rows)) for _, s, t in states}


@pytest.mark.parametrize(("name", "first"), [("j_09_pairs", "i"), ("flt_11_long_lag_pairs", "i")])
def test_pairs_of_states_are_spread(spark, name, first):
    """The states are a small file, which one task would join with itself."""
    from pyspark.sql import functions as F

    pairs = QUERIES[name](spark, "/root/testdata/sf0.01")
    tasks = pairs.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) >= 2 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("blocks", [5, 48])
def test_chunks_come_in_order_and_blocks_together(small, spark, monkeypatch, blocks):
    """Spark leaves out a sort below a join: blocks that shared a task then came apart, and gave a state several rows."""
    monkeypatch.setattr(A, "CHUNK", 16)
    monkeypatch.setattr(A, "BLOCKS", blocks)
    _, states, units, saved = small

    def seen(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("block").cast(pa.int64()), batch.column("chunk")], ["block", "chunk"])

    chunks = A.materialised(A.packed(units, [])).repartition(3)
    rows = A._dealt(chunks, saved).coalesce(1).select("block", "chunk").mapInArrow(seen, "block long, chunk long").collect()
    got = [tuple(r) for r in rows]
    runs = [b for k, (b, _) in enumerate(got) if k == 0 or b != got[k - 1][0]]
    assert len(runs) == len(set(runs)) and all(a[0] != b[0] or a[1] < b[1] for a, b in zip(got, got[1:]))


def folding(node, seed, step):
    return (node // (step % 7 * 9 + 2) + node % (seed + 2)) % 4 + 1


folding.folds = lambda seed, step: (step % 7 * 9 + 2, seed + 2)


@pytest.mark.parametrize("run", [0, 8])
def test_folds_give_what_all_units_give(small, monkeypatch, run):
    """Sums at the ends of runs, for all states or for those of long runs, against the labels of every unit."""
    monkeypatch.setattr(A, "CHUNK", 64)
    monkeypatch.setattr(A, "RUN", run)
    _, _, units, saved = small
    plain = lambda node, seed, step: folding(node, seed, step)
    pairs = saved.selectExpr("seed", "step", "'x' AS to", "step - 9 AS other")
    counties = ["000", "001", "002", None]
    for f in (
        lambda of: A.district_sums(units, saved, of, 4, "totpop", "dem"),
        lambda of: A.county_kinds(units, saved, of, 4, counties),
        lambda of: A.county_mass(units, saved, of, 4, counties, 2),
        lambda of: A.distances_to(units, saved, of, 4, counties),
        lambda of: A.similarity_to(units, saved, of, 4),
        lambda of: A.similarity_along(units, pairs, of, 4),
        lambda of: A.same_label(units, pairs, of),
    ):
        got, want = ({tuple(r) for r in f(of).collect()} for of in (folding, plain))
        assert got == want and got


def test_work_on_saved_states_does_not_grow_with_units_times_states():
    """Labels worked out over 2,000 states of 20,000 units: not those of every unit of every state."""
    n, seen = 20_000, 0
    rng = np.random.default_rng(5)
    data = {"node": np.arange(7, 7 + n), "totpop": rng.integers(0, 100, n)}
    folds = A.folds(views.saved_labels, "step")
    for step in range(99, 200_000, 100):
        widths, period = folds({"seed": 2, "step": step})
        f = A.Folded(data, [], ["totpop"], period) if step == 99 else f
        if A.RUN * f.runs(widths) > n:
            seen += n
            continue
        some, sums = f.cut(widths)
        seen += len(some["node"])
        if step % 1000 == 999:
            label = views.saved_labels(data["node"], 2, step)
            got = [np.bincount(views.saved_labels(some["node"], 2, step), m, 15).tolist() for m in sums]
            assert got == [np.bincount(label, m, 15).tolist() for m in (np.ones(n), data["totpop"])]
    assert seen < n * 2_000 / 20


@pytest.mark.parametrize("name", ["agg_25_seed_range", "int_06_final_checkpoint", "j_11_trace_checkpoint"])
def test_what_needs_no_votes_reads_no_blocks(spark, monkeypatch, name):
    monkeypatch.setattr(views.Views, "blocks", property(lambda _: pytest.fail("blocks were read")))
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("chunk", [64, 1 << 17])
def test_checkpoints_hold_runs_of_labels(spark, tmp_path, monkeypatch, chunk):
    """States of long runs are saved by run and come back whole; those of short ones unit by unit."""
    monkeypatch.setattr(A, "CHUNK", chunk)
    rng = np.random.default_rng(8)
    nodes = sorted(rng.choice(90_000, 60_000, replace=False).tolist()) if chunk > 64 else sorted(rng.choice(600, 300, replace=False).tolist())
    states = [("x", s, t) for s in (0, 1) for t in (99, 9_999, 199_999)]
    units = spark.createDataFrame([(n,) for n in nodes], "node long")
    saved = spark.createDataFrame(states, "experiment string, seed int, step long")
    path = str(tmp_path / "c")
    A.checkpoints(units, saved, views.saved_labels).write.partitionBy("experiment", "seed").parquet(path)
    rows = spark.read.schema(A.CHECKPOINT).parquet(path)
    got = A.read_checkpoints(rows).collect()
    n = np.array(nodes)
    assert {(r.seed, r.step): (r.units, r.nodes, r.labels) for r in got} == {(s, t): (len(n), len(n), int(views.saved_labels(n, s, t).sum())) for _, s, t in states}
    if chunk > 64:
        sizes = {(r.seed, r.step): len(r.labels) for r in rows.collect()}
        assert all(sizes[s, 199_999] < 600 for s in (0, 1))
        broken = rows.withColumn("labels", rows.nodes).where("step = 199999")
        with pytest.raises(Exception, match="labels of runs"):
            A.read_checkpoints(broken).collect()

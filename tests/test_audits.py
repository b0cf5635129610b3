"""R-hat by audit length, plans along a chain, diagnostics without each chain: against arrays and permutations."""

import itertools
import math

import numpy as np
import pytest

from mapstats.functions import diagnostics as D
from mapstats.operators import convergence as C
from mapstats.operators import partition as P
from mapstats.plans.chains import audits
from mapstats.plans.diagnostics import METRICS, thinned_sizes, without_each
from mapstats.plans.partitions import along_chain


def split_rhat(x):
    h = x.shape[1] // 2
    halves = np.concatenate([x[:, :h], x[:, h : 2 * h]])
    within = halves.var(axis=1, ddof=1).mean()
    return math.sqrt(((h - 1) * within + h * halves.mean(axis=1).var(ddof=1)) / h / within) if within else None


def test_audits_against_arrays(spark):
    rng = np.random.default_rng(5)
    chains = {("p", 1): 57, ("p", 2): 43, ("q", 3): 9, ("q", 4): 30, ("r", 5): 20}
    data = {k: (rng.integers(590, 700, n), np.full(n, 7)) for k, n in chains.items()}
    rows = [(e, s, t, int(a), int(b)) for (e, s), (x, y) in data.items() for t, (a, b) in enumerate(zip(x, y, strict=True))]
    trace = spark.createDataFrame(rows, "experiment string, seed int, step long, cut_edges int, dem_seats int").repartition(3)
    got = {(r.experiment, r.metric, r.states): r for r in audits(trace, width=10).collect()}
    want = {"p": [10, 20, 30, 40], "q": [], "r": [10, 20]}
    assert set(got) == {(e, m, n) for e, ns in want.items() for m in ("cut_edges", "dem_seats") for n in ns}
    for e, ns in want.items():
        before = None
        for n in ns:
            r = split_rhat(np.stack([x[:n] for (k, _), (x, _) in data.items() if k == e]))
            assert got[e, "cut_edges", n].r_hat == pytest.approx(r, abs=1e-9)
            assert got[e, "cut_edges", n].change == (None if before is None else pytest.approx(r - before, abs=1e-9))
            assert got[e, "dem_seats", n].r_hat is None and got[e, "dem_seats", n].change is None
            before = r


def test_audits_of_nothing(spark):
    assert audits(spark.createDataFrame([], "experiment string, seed int, step long, cut_edges int, dem_seats int")).count() == 0


def test_plans_along_a_chain_against_permutations(spark):
    rng = np.random.default_rng(8)
    weight = rng.integers(1, 50, 24)
    plans = {(s, t): rng.integers(1, 5, 24) for s in (0, 1) for t in (99, 199, 299)}
    plans[0, 199] = plans[0, 99] % 4 + 1  # the same plan under other labels
    rows = [(s, t, node, int(weight[node]), int(d)) for (s, t), p in plans.items() for node, d in enumerate(p)]
    assign = spark.createDataFrame(rows, "seed int, step long, node long, totpop long, district int").repartition(4)
    got = {(r.seed, r.step, r.to): r.similarity for r in P.population_similarity(along_chain(assign), "seed", "step", "to").collect()}

    def best(a, b):
        return max(weight[np.array([0, *m])[a] == b].sum() for m in itertools.permutations(range(1, 5))) / weight.sum()

    want = {(s, t, to): best(plans[s, t], plans[s, t - 100 if to == "previous" else 99]) for s in (0, 1) for t in (199, 299) for to in ("previous", "first")}
    assert set(got) == set(want) and got[0, 199, "first"] == 1.0
    assert all(got[k] == pytest.approx(w, abs=1e-12) for k, w in want.items())


def test_the_chain_that_disagrees_is_found(spark):
    rng = np.random.default_rng(21)
    chains = {s: rng.normal(size=(len(METRICS), n)) + (4 if s == 2 else 0) for s, n in ((1, 90), (2, 80), (3, 86), (4, 70))}
    rows = [("e", s, t, *map(float, x[:, t])) for s, x in chains.items() for t in range(x.shape[1])]
    trace = spark.createDataFrame(rows, f"experiment string, seed int, step long, {', '.join(f'{m} double' for m in METRICS)}").repartition(3)
    got = {(r.cohort, r.metric): r for r in C.statistics(without_each(trace).drop("omitted")).collect()}
    assert len(got) == len(chains) * len(METRICS)
    for omitted in chains:
        left = [x for s, x in chains.items() if s != omitted]
        n = min(x.shape[1] for x in left)
        for k, m in enumerate(METRICS):
            x, r = np.stack([y[k, :n] for y in left]), got[f"without_{omitted}", m]
            assert (r.chains, r.states) == (3, 3 * n)
            assert r.mean == pytest.approx(x.mean()) and r.bulk_ess == pytest.approx(D.STATISTICS["bulk_ess"](x))
            assert r.r_hat == pytest.approx(D.STATISTICS["r_hat"](x)) and (r.r_hat < 1.1) == (omitted == 2)


def test_thinned_sizes_against_arrays(spark):
    rng = np.random.default_rng(3)
    walk = np.cumsum(rng.normal(size=240)) * 0.3 + rng.normal(size=240)
    chains = {1: walk, 2: rng.normal(size=131), 3: rng.normal(size=12)}  # the last ends before the warm-up does
    trace = spark.createDataFrame([(s, t, float(x)) for s, xs in chains.items() for t, x in enumerate(xs)], "seed int, step long, value double").repartition(3)
    got = {(r.seed, r.k): r for r in thinned_sizes(trace, "value", (1, 3, 10), 20).collect()}
    assert set(got) == {(s, k) for s in (1, 2) for k in (1, 3, 10)}

    def size(x):
        c, total = x - x.mean(), 1.0
        for lag in range(1, len(x)):
            rho = (c[lag:] * c[:-lag]).sum() / ((len(x) - lag) * x.var())
            if rho <= 0:
                break
            total += 2 * rho
        return len(x) / total

    for (s, k), r in got.items():
        x, whole = chains[s][20::k], chains[s][20:]
        assert r.retained == len(x) and r.mean == pytest.approx(x.mean()) and r.sd == pytest.approx(x.std(ddof=1))
        assert r.ess == pytest.approx(size(x)) and r.ess_per_draw == pytest.approx(size(x) / len(x))
        assert r.mean_delta == pytest.approx(x.mean() - whole.mean(), abs=1e-12) and r.ess_delta == pytest.approx(size(x) - size(whole), abs=1e-9)
    with pytest.raises(ValueError):
        thinned_sizes(trace, "value", (2, 3))

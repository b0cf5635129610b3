import math

import numpy as np
import pytest
from statistics import NormalDist

from pyspark.sql import functions as F

from mapstats.functions import diagnostics as D
from mapstats.operators import convergence as C
from mapstats.operators import ordering

SCHEMA = "cohort string, metric string, seed int, step long, value double"


def cohorts():
    rng = np.random.default_rng(11)
    walk = lambda n, a: np.array([x := 0.0] + [x := a * x + e for e in rng.normal(size=n - 1)])
    return {
        ("a", "slow"): np.stack([walk(700, 0.995) for _ in range(3)]),
        ("a", "ties"): rng.integers(0, 5, (4, 301)).astype(float),
        ("b", "odd"): rng.normal(size=(2, 257)),
        ("b", "shifted"): rng.normal(size=(2, 120)) + np.array([[0.0], [3.0]]),
        ("b", "constant"): np.full((2, 40), 7.0),
        ("c", "rare"): (rng.random((3, 150)) < 0.03).astype(float),
        ("c", "single"): rng.normal(size=(1, 64)),
    }


def draws(spark, given):
    return spark.createDataFrame([(c, m, k, t, float(v)) for (c, m), x in given.items() for k, row in enumerate(x) for t, v in enumerate(row)], SCHEMA).repartition(5)


def close(got, want):
    if got is None or not math.isfinite(got):
        return want is None or not math.isfinite(want)
    return got == pytest.approx(want, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("block", [512, 16])
def test_statistics_equal_those_of_arrays(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    given = cohorts()
    rows = {(r.cohort, r.metric): r for r in C.statistics(draws(spark, given)).collect()}
    assert set(rows) == set(given)
    for key, x in given.items():
        with np.errstate(all="ignore"):
            want = {n: f(x) for n, f in D.STATISTICS.items()} | {"ess_mean": D.ess(D.split(x)), "mean": x.mean(), "sd": x.std(ddof=1), "q05": np.quantile(x, 0.05), "q95": np.quantile(x, 0.95)}
        for n, w in want.items():
            assert close(rows[key][n], w), (key, n, rows[key][n], w)


def test_report_equals_that_of_arrays(spark):
    given = {k: v for k, v in cohorts().items() if k[0] != "c"}
    for r in C.report(draws(spark, given)).collect():
        want = D.diagnose(given[r.cohort, r.metric])
        for n in ("ess_screening_minimum", "all_finite", "screening_flags", "issues"):
            assert r[n] == want[n], (r.metric, n)


@pytest.mark.parametrize("block", [512, 16])
def test_sizes_of_chains(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    given = {f"{c}-{m}-{k}": row for (c, m), x in cohorts().items() for k, row in enumerate(x)} | {"two": np.array([1.0, 2.0]), "five": np.array([1.0, 2, 3, 4, 5])}
    df = spark.createDataFrame([(n, t, float(v)) for n, x in given.items() for t, v in enumerate(x)], "chain string, pos long, value double")
    got = {r.chain: r for r in C.chain_sizes(df, ["chain"]).collect()}
    for n, x in given.items():
        assert close(got[n].simple_ess, D.simple_ess(x)) and close(got[n].pair_ess, D.pair_ess(x)), n


def test_normal_quantile(spark):
    p = [1e-300, 1e-20, 1e-9, 0.001, 0.0749, 0.075, 0.3, 0.5, 0.77, 0.925, 0.9999999]
    got = [r[0] for r in C.with_normal_quantile(spark.createDataFrame([(x,) for x in p], "p double"), "z", F.col("p")).select("z").collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(x) for x in p], rel=1e-12, abs=1e-15)


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sums(spark, parts):
    rng = np.random.default_rng(2)
    rows = [(int(g) if g else None, int(o), int(n)) for g, o, n in zip(rng.integers(0, 3, 400), rng.integers(0, 1000, 400), rng.integers(0, 9, 400))]
    rows = list({(g, o): (g, o, n) for g, o, n in rows}.values())
    got = sorted(map(tuple, ordering.cumulative(spark.createDataFrame(rows, "g int, o int, n int"), ["g"], ["o"], "n", parts=parts).collect()), key=str)
    assert got == sorted(((g, o, n, sum(m for h, q, m in rows if h == g and q < o)) for g, o, n in rows), key=str)
    placed = ordering.numbered(spark.range(500).repartition(9).withColumnRenamed("id", "x"), "x").collect()
    assert all(r.x == r.place for r in placed) and len(placed) == 500

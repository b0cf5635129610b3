import math

import numpy as np
import pytest

from mapstats.functions import diagnostics as D


def ar1(seed, shape, phi):
    r = np.random.default_rng(seed)
    x = np.zeros(shape)
    e = r.normal(size=shape)
    for t in range(1, shape[1]):
        x[:, t] = phi * x[:, t - 1] + e[:, t]
    return x


@pytest.mark.parametrize("chains", [2, 3, 6])
def test_independent_draws_pass_all_screens(chains):
    x = np.random.default_rng(chains).uniform(-5, 9, size=(chains, 1300))
    got = D.diagnose(x)
    assert got["screening_flags"] == [] and got["issues"] == [] and got["ess_screening_minimum"] == max(400, 100 * chains)
    assert got["bulk_ess"] == pytest.approx(x.size, rel=0.3) and got["mcse_mean"] == pytest.approx(14 / math.sqrt(12 * x.size), rel=0.3)


def test_what_cannot_be_measured_is_said():
    got = D.diagnose(np.full((3, 77), -2.5))
    assert got["r_hat"] is None and got["issues"] == ["r_hat is not finite"] and "r_hat" in got["screening_flags"]
    stuck = np.repeat([[1.0], [2.0]], 600, axis=1)
    assert D.diagnose(stuck)["r_hat"] is None


def test_autocorrelation_and_shift():
    x = ar1(3, (4, 4000), 0.9)
    assert D.ess(x) == pytest.approx(x.size * 0.1 / 1.9, rel=0.25)
    assert D.rank_rhat(x + np.arange(4)[:, None] * 5) > 1.2
    assert D.mcse_sd(x) / D.mcse_mean(x) == pytest.approx(1 / math.sqrt(2), rel=0.5)


def test_simple_sizes():
    assert D.simple_ess(np.array([1.0, 1.0])) == 2 and D.simple_ess(np.ones(9)) == 9
    assert math.isnan(D.pair_ess(np.ones(9))) and math.isnan(D.pair_ess(np.array([1.0, 2.0, 1.0])))
    x = ar1(5, (1, 3000), 0.5)[0]
    assert D.simple_ess(x) == pytest.approx(1000, rel=0.3) and D.pair_ess(x) == pytest.approx(1000, rel=0.3)


def test_beta_quantiles():
    assert D.beta_quantile(1, 1, 0.3) == pytest.approx(0.3)
    assert D.beta_cdf(2, 3, 0.4) == pytest.approx(0.5248)
    assert D.beta_cdf(50, 30, D.beta_quantile(50, 30, 0.16)) == pytest.approx(0.16)


def test_tail_indicator_counts_events_and_runs():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 6, (3, 90)).astype(float)
    got = D.tail_indicator(x, 1)
    runs = sum(len("".join("x" if v <= 1 else " " for v in row).split()) for row in x)
    assert (got["events"], got["runs"], got["status"]) == (int((x <= 1).sum()), runs, "available")
    assert D.tail_indicator(x, 9)["status"] == D.tail_indicator(x, -1)["status"] == "unavailable_constant_indicator"


def test_difference_of_cohorts():
    assert D.independent_difference(2.5, -1.5, 1.5, 2.0) == (4, 2.5, 1.6)
    assert D.independent_difference(7, 7, 0, 0) == (0, 0, None)

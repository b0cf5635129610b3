"""Convergence diagnostics of chains x draws: effective sizes, R-hat and Monte Carlo errors.

Rank-normalised split R-hat, bulk and tail effective sizes and the errors follow Vehtari,
Gelman, Simpson, Carpenter and Buerkner (2021); the two simple effective sizes stop at the
first non-positive autocorrelation and at the first non-positive pair.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def autocovariance(x: np.ndarray) -> np.ndarray:
    """Biased autocovariances at every lag."""
    n = len(x)
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(x - x.mean(), size)
    return np.fft.irfft(f * np.conj(f), size)[:n] / n


def simple_ess(x: np.ndarray) -> float:
    n = len(x)
    c = x - x.mean() if n else x
    variance = float((c**2).sum() / n) if n else 0.0
    if n < 3 or variance == 0:
        return float(n)
    total = 0.0
    for lag in range(1, n // 2):
        r = float(c[:-lag] @ c[lag:]) / ((n - lag) * variance)
        if r <= 0:
            break
        total += r
    return n / (1 + 2 * total)


def pair_ess(x: np.ndarray) -> float:
    n = len(x)
    if n < 4 or np.ptp(x) == 0:
        return math.nan
    raw = autocovariance(x) * n / (n - np.arange(n))
    rho, tau = raw / raw[0], 1.0
    for k in range(1, n - 1, 2):
        pair = rho[k] + rho[k + 1]
        if pair <= 0:
            break
        tau += 2 * pair
    return float(min(n, n / tau))


def split(x: np.ndarray) -> np.ndarray:
    """Each chain's first and last half; an odd middle draw is left out."""
    h = x.shape[1] // 2
    return np.concatenate([x[:, :h], x[:, x.shape[1] - h :]])


def split_rhat(x: np.ndarray) -> float:
    s = split(x)
    n = s.shape[1]
    if n < 2:
        return math.nan
    w, b = s.var(axis=1, ddof=1).mean(), n * s.mean(axis=1).var(ddof=1)
    return float(math.sqrt(((n - 1) * w + b) / n / w)) if w > 0 else math.nan


def z_scale(x: np.ndarray) -> np.ndarray:
    """Normal scores of average ranks over all draws."""
    values, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    rank = np.cumsum(counts) - (counts - 1) / 2
    inv = NormalDist().inv_cdf
    score = np.array([inv(p) for p in (rank - 0.375) / (x.size + 0.25)])
    return score[inverse].reshape(x.shape)


def rank_rhat(x: np.ndarray) -> float:
    folded = np.abs(x - np.median(x))
    got = [split_rhat(z_scale(v)) for v in (x, folded)]
    return max(got) if all(map(math.isfinite, got)) else math.nan


def ess(x: np.ndarray) -> float:
    """Effective size of the mean of chains x draws, by Geyer's initial monotone sequence."""
    m, n = x.shape
    if n < 4 or not np.isfinite(x).all():
        return math.nan
    if np.ptp(x) == 0:
        return float(x.size)
    cov = np.array([autocovariance(c) for c in x])
    w = cov[:, 0].mean() * n / (n - 1)
    plus = w * (n - 1) / n + (x.mean(axis=1).var(ddof=1) if m > 1 else 0.0)
    rho = 1 - (w - cov.mean(axis=0)) / plus
    rho[0] = 1.0
    pairs: list[float] = []
    for k in range(0, n - 3, 2):
        p = float(rho[k] + rho[k + 1])
        if k and p <= 0:
            break
        pairs.append(min(p, pairs[-1]) if pairs else p)
    after = 2 * len(pairs)
    tail = max(float(rho[after]), 0.0) if after < n else 0.0
    tau = max(-1 + 2 * sum(pairs) + tail, 1 / math.log10(m * n))
    return float(m * n / tau)


def bulk_ess(x: np.ndarray) -> float:
    return ess(z_scale(split(x))) if np.ptp(x) else float(x.size)


def quantile_ess(x: np.ndarray, p: float) -> float:
    return ess(split((x <= np.quantile(x, p)).astype(float)))


def tail_ess(x: np.ndarray) -> float:
    return min(quantile_ess(x, 0.05), quantile_ess(x, 0.95))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def beta_quantile(a: float, b: float, p: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(a, b, mid) < p else (low, mid)
    return (low + high) / 2


def mcse_mean(x: np.ndarray) -> float:
    return float(x.std(ddof=1) / math.sqrt(ess(split(x))))


def mcse_sd(x: np.ndarray) -> float:
    size = min(ess(split(x)), ess(split(x**2)))
    if not size > 1:
        return math.nan
    factor = math.exp(1) * (1 - 1 / size) ** (size - 1) - 1
    return float(x.std(ddof=1) * math.sqrt(max(factor, 0.0)))


def mcse_quantile(x: np.ndarray, p: float) -> float:
    size = quantile_ess(x, p)
    ends = [beta_quantile(size * p + 1, size * (1 - p) + 1, q) for q in (0.1586553, 0.8413447)]
    flat = np.sort(x, axis=None)
    low = flat[max(0, math.floor(ends[0] * flat.size) - 1)]
    high = flat[min(flat.size - 1, math.ceil(ends[1] * flat.size) - 1)]
    return float((high - low) / 2)


STATISTICS = {
    "r_hat": rank_rhat,
    "bulk_ess": bulk_ess,
    "tail_ess": tail_ess,
    "mcse_mean": mcse_mean,
    "mcse_sd": mcse_sd,
    "mcse_q05": lambda x: mcse_quantile(x, 0.05),
    "mcse_q95": lambda x: mcse_quantile(x, 0.95),
}


def diagnose(x: np.ndarray) -> dict:
    """All statistics, non-finite ones as null with an issue; flags of what misses the screens."""
    out: dict = {}
    issues = []
    for name, f in STATISTICS.items():
        try:
            with np.errstate(all="ignore"):
                value = float(f(x))
        except (ValueError, ZeroDivisionError, FloatingPointError) as e:
            value = math.nan
            issues.append(f"{name}: {e}")
        if not math.isfinite(value):
            issues.append(f"{name} is not finite")
        out[name] = value if math.isfinite(value) else None
    least = max(400, 100 * x.shape[0])
    flags = [n for n, bad in (("r_hat", out["r_hat"] is None or out["r_hat"] >= 1.01), ("bulk_ess", out["bulk_ess"] is None or out["bulk_ess"] < least), ("tail_ess", out["tail_ess"] is None or out["tail_ess"] < least)) if bad]
    return out | {"ess_screening_minimum": least, "all_finite": not issues, "screening_flags": flags, "issues": issues}


def tail_indicator(x: np.ndarray, threshold: float) -> dict:
    """Events at or below a threshold: frequency, runs, and diagnostics unless the indicator is constant."""
    e = x <= threshold
    runs = int(e[:, 0].sum() + (e[:, 1:] & ~e[:, :-1]).sum())
    out = {"events": int(e.sum()), "frequency": float(e.mean()), "runs": runs}
    if e.all() or not e.any():
        return out | {"status": "unavailable_constant_indicator", "mcse": None, "ess": None, "r_hat": None}
    i = e.astype(float)
    r = rank_rhat(i)
    return out | {"status": "available", "mcse": mcse_mean(i), "ess": ess(split(i)), "r_hat": r if math.isfinite(r) else None}


def independent_difference(a: float, b: float, mcse_a: float, mcse_b: float) -> tuple[float, float, float | None]:
    """Difference, combined error, and their ratio unless the error is 0."""
    combined = math.hypot(mcse_a, mcse_b)
    return abs(a - b), combined, abs(a - b) / combined if combined else None

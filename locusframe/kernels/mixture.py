"""The zero-inflated mixture of two negative binomials, fitted on a histogram of counts."""

from __future__ import annotations

from dataclasses import dataclass
from math import lgamma

import numpy as np

from locusframe.kernels.numeric import log_gamma, negative_binomial_log_pmf

_TINY = float(np.finfo(float).tiny)


@dataclass(frozen=True)
class Mixture:
    """prob0 zeros; of the rest prob1 from the first (background) and 1 - prob1 from the second component."""

    mu1: float
    theta1: float
    mu2: float
    theta2: float
    prob0: float
    prob1: float


def posteriors(count: np.ndarray, m: Mixture) -> np.ndarray:
    """Rows: shares of zero, first and second component for each count."""
    zero = m.prob0 * (np.asarray(count) == 0)
    one = (1 - m.prob0) * m.prob1 * np.exp(negative_binomial_log_pmf(count, m.mu1, m.theta1))
    two = (1 - m.prob0) * (1 - m.prob1) * np.exp(negative_binomial_log_pmf(count, m.mu2, m.theta2))
    parts = np.maximum(np.stack([zero, one, two]), _TINY)
    return parts / parts.sum(axis=0)


def log_likelihood(count: np.ndarray, n: np.ndarray, m: Mixture) -> float:
    zero = m.prob0 * (np.asarray(count) == 0)
    one = (1 - m.prob0) * m.prob1 * np.exp(negative_binomial_log_pmf(count, m.mu1, m.theta1))
    two = (1 - m.prob0) * (1 - m.prob1) * np.exp(negative_binomial_log_pmf(count, m.mu2, m.theta2))
    return float((n * np.log(np.maximum(zero + one + two, _TINY))).sum())


def expected_log_likelihood(count: np.ndarray, n: np.ndarray, m: Mixture, zero: np.ndarray, one: np.ndarray) -> tuple[float, np.ndarray]:
    """What the EM steps bring down, and the test value of each count, for shares zero and one of the first two components.

    The first is minus the sum over rows and components of z * ln(p / z), the second -2 (ln(p2 / z2) - ln(p1 / z1)).
    Shares and probabilities of 0 count as the smallest normal number.
    """
    some = lambda x: np.where(np.asarray(x, float) == 0, _TINY, x)
    z = [some(zero), some(one), some(1 - np.asarray(zero, float) - np.asarray(one, float))]
    p0, rest, p1, p2 = (float(some(x)) for x in (m.prob0, 1 - m.prob0, m.prob1, 1 - m.prob1))
    parts = [p0 * (np.asarray(count) == 0), rest * p1 * np.exp(negative_binomial_log_pmf(count, m.mu1, m.theta1)), rest * p2 * np.exp(negative_binomial_log_pmf(count, m.mu2, m.theta2))]
    with np.errstate(divide="ignore"):
        logs = [np.log(p / k) for p, k in zip(parts, z, strict=True)]
    logs = [np.where(np.isneginf(x), np.log(_TINY), x) for x in logs]
    third = 1 - z[0] - z[1]
    total = float((n * (logs[0] * z[0] + logs[1] * z[1] + logs[2] * third)).sum())
    return -total, -2 * (logs[2] - logs[1])


def _theta(count: np.ndarray, weight: np.ndarray, mu: float, lo: float = 1e-3, hi: float = 1e4) -> float:
    """The dispersion of most weighted likelihood at a mean, by golden section in its logarithm."""
    a, b = np.log(lo), np.log(hi)
    g = (np.sqrt(5) - 1) / 2
    total, first = float(weight.sum()), float((weight * count).sum())

    def value(t: float) -> float:  # without what doesn't depend on the dispersion
        theta = np.exp(t)
        return float((weight * log_gamma(count + theta)).sum()) - total * (lgamma(theta) - theta * np.log(theta / (theta + mu))) - first * np.log(theta + mu)

    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = value(c), value(d)
    while b - a > 1e-7:
        if fc > fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = value(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = value(d)
    return float(np.exp((a + b) / 2))


def fit(count: np.ndarray, n: np.ndarray, start: Mixture, tolerance: float = 1e-8, rounds: int = 500) -> tuple[Mixture, list[float]]:
    """Expectation-maximisation; the second component has the larger mean. Returns the fit and the log likelihood of each round."""
    count, n = np.asarray(count, float), np.asarray(n, float)
    m, seen = start, [log_likelihood(count, n, start)]
    for _ in range(rounds):
        z0, z1, z2 = posteriors(count, m) * n
        mu1, mu2 = (z1 * count).sum() / z1.sum(), (z2 * count).sum() / z2.sum()
        m = Mixture(mu1, _theta(count, z1, max(mu1, 1e-9)), mu2, _theta(count, z2, max(mu2, 1e-9)), z0.sum() / n.sum(), z1.sum() / (n.sum() - z0.sum()))
        seen.append(log_likelihood(count, n, m))
        if abs(seen[-1] - seen[-2]) <= tolerance * abs(seen[-2]):
            break
    if m.mu1 > m.mu2:
        m = Mixture(m.mu2, m.theta2, m.mu1, m.theta1, m.prob0, 1 - m.prob1)
    return m, seen


def score_grid(top: int, m: Mixture) -> np.ndarray:
    """Log-likelihood ratio of the second to the first component for counts 0..top."""
    c = np.arange(top + 1)
    return np.log((1 - m.prob1) / m.prob1) + negative_binomial_log_pmf(c, m.mu2, m.theta2) - negative_binomial_log_pmf(c, m.mu1, m.theta1)

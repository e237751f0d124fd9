"""Distribution functions and robust fits without scipy."""

from __future__ import annotations

from functools import lru_cache
from math import erfc, lgamma

import numpy as np


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function of positive numbers: Stirling's series from 8 on, and the recurrence below that."""
    x = np.asarray(x, float)
    low = x < 8
    y = np.where(low, x + 8, x)
    r = 1 / (y * y)
    out = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / y
    if low.any():
        z = np.where(low, x, 1.0)
        out = np.where(low, out - np.log(np.prod([z + k for k in range(8)], axis=0)), out)
    return out



@lru_cache(maxsize=256)
def log_factorials(n: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))]) if n > 0 else np.zeros(1)


def binomial_cdf(k: np.ndarray | float, n: float, p: float) -> np.ndarray:
    """P(X <= k) of binomial counts for one n and p, from a running sum of probabilities; n and k are rounded down."""
    k, n = np.floor(np.asarray(k, float)).astype(np.int64), int(np.floor(n))
    if n <= 0 or p <= 0:
        table = np.ones(max(n, 0) + 1)
    elif p >= 1:
        table = np.concatenate([np.zeros(n), [1.0]])
    else:
        facts, j = log_factorials(n), np.arange(n + 1)
        table = np.minimum(1.0, np.cumsum(np.exp(facts[n] - facts - facts[::-1] + j * np.log(p) + (n - j) * np.log1p(-p))))
    return np.where(k < 0, 0.0, table[np.clip(k, 0, max(n, 0))])


def binomial_cdfs(k: np.ndarray, n: np.ndarray, p: np.ndarray | float) -> np.ndarray:
    """P(X <= k) of binomial counts, element by element; k and n are rounded down. Time doesn't grow with n: the regularised incomplete beta function, by its continued fraction."""
    k, n, p = (np.asarray(x, float) for x in np.broadcast_arrays(k, n, p))
    k, n = np.floor(k), np.floor(n)
    out = np.where((k < 0) | (p >= 1) & (k < n), 0.0, 1.0)
    some = (k >= 0) & (k < n) & (p > 0) & (p < 1)
    a, b, p = n[some] - k[some], k[some] + 1, p[some]
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log1p(-p) + b * np.log(p))
    swap = (1 - p) * (a + b + 2) > a + 1  # the fraction converges fast on one side of the mean
    part = front * _beta_fraction(np.where(swap, b, a), np.where(swap, a, b), np.where(swap, p, 1 - p))
    out[some] = np.clip(np.where(swap, 1 - part / b, part / a), 0.0, 1.0)
    return out


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function by Lentz's method; terms are added until they change nothing."""
    tiny, out, at = 1e-300, np.ones(len(a)), np.arange(len(a))
    safe = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones(len(a)), 1 / safe(1 - (a + b) * x / (a + 1))
    h, m = d.copy(), 0
    while len(at):
        m += 1
        term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / safe(1 + term * d), safe(1 + term / c)
        h = h * d * c
        term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / safe(1 + term * d), safe(1 + term / c)
        h = h * d * c
        done = (np.abs(d * c - 1) < 1e-15) | (m >= 1_000_000)
        if done.any():
            out[at[done]] = h[done]
            left = ~done
            a, b, x, c, d, h, at = (v[left] for v in (a, b, x, c, d, h, at))
    return out


def negative_binomial_log_pmf(count: np.ndarray, mu: float, theta: float) -> np.ndarray:
    c = np.asarray(count, float)
    return log_gamma(c + theta) - lgamma(theta) - log_gamma(c + 1) + theta * np.log(theta / (theta + mu)) + c * np.log(mu / (mu + theta))


def kolmogorov_p(d: float, n: int, m: int) -> float:
    """The asymptotic two-sample p-value of the statistic d."""
    x = d * np.sqrt(n * m / (n + m))
    if x < 1e-3:
        return 1.0
    j = np.arange(1, 101)
    return float(min(1.0, max(0.0, 2 * np.sum((-1.0) ** (j - 1) * np.exp(-2 * j**2 * x**2)))))


def ks_statistic(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.sort(a), np.sort(b)
    x = np.concatenate([a, b])
    return float(np.abs(np.searchsorted(a, x, side="right") / len(a) - np.searchsorted(b, x, side="right") / len(b)).max())


def gamma_q(s: float, x: float) -> float:
    """The upper regularised incomplete gamma function."""
    if x <= 0 or s <= 0:
        return 1.0
    head = np.exp(s * np.log(x) - x - lgamma(s))
    if x < s + 1:
        term = total = 1 / s
        for k in range(1, 2000):
            term *= x / (s + k)
            total += term
            if term < total * 1e-16:
                break
        return float(min(1.0, max(0.0, 1 - head * total)))
    b, c = x + 1 - s, 1e300
    d = h = 1 / b
    for k in range(1, 2000):
        a = -k * (k - s)
        b += 2
        d = 1 / (a * d + b or 1e-300)
        c = b + a / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return float(min(1.0, max(0.0, head * h)))


def chi_square(table: np.ndarray) -> tuple[float, int]:
    """Statistic and degrees of freedom of a table, empty rows and columns left out."""
    t = table[table.sum(axis=1) > 0][:, table.sum(axis=0) > 0].astype(float)
    if t.size == 0:
        return 0.0, 0
    e = t.sum(axis=1, keepdims=True) * t.sum(axis=0, keepdims=True) / t.sum()
    return float(((t - e) ** 2 / e).sum()), (t.shape[0] - 1) * (t.shape[1] - 1)


def chi_square_p(table: np.ndarray) -> float:
    x, df = chi_square(table)
    return gamma_q(df / 2, x / 2) if df else 1.0


_erfc = np.frompyfunc(erfc, 1, 1)


def chi_square_ps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """chi_square_p() of many tables at once: a and b are (tables, levels), the counts of the two sides."""
    levels, na, nb = (a + b).astype(float), a.sum(axis=1, keepdims=True), b.sum(axis=1, keepdims=True)
    x, total = np.zeros(len(a)), np.maximum(na + nb, 1)
    for side, n in ((a, na), (b, nb)):
        e = levels * n / total
        x += np.divide((side - e) ** 2, e, out=np.zeros_like(e), where=e > 0).sum(axis=1)
    df = np.where((na > 0) & (nb > 0), (levels > 0).sum(axis=1, keepdims=True) - 1, 0)[:, 0]
    # Tail areas of half the degrees of freedom, from those of 1 or 2 degrees up.
    half, out = x / 2, np.ones(len(a))
    for odd in (0, 1):
        s = 1 - odd / 2
        tail = _erfc(np.sqrt(half)).astype(float) if odd else np.exp(-half)
        for d in range(2 - odd, int(df.max(initial=0)) + 1, 2):
            out = np.where(df == d, tail, out)
            tail = tail + np.exp(np.log(np.maximum(half, 1e-300)) * s - half - lgamma(s + 1))
            s += 1
    return out


def bisquare_fit(x: np.ndarray, y: np.ndarray, c: float = 4.685, rounds: int = 1000, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (intercept first) and weights of Tukey's bisquare M-estimate: least squares start, scale from the median absolute residual."""
    a = np.column_stack([np.ones(len(x)), x])
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    weights = np.ones(len(y))
    for _ in range(rounds):
        r = y - a @ beta
        scale = np.median(np.abs(r)) / 0.6745
        if scale <= 1e-12:
            break
        u = r / (c * scale)
        weights = np.where(np.abs(u) < 1, (1 - u**2) ** 2, 0.0)
        root = np.sqrt(weights)
        new = np.linalg.lstsq(a * root[:, None], y * root, rcond=None)[0]
        done = np.abs(new - beta).max() <= tol * max(1e-12, np.abs(beta).max())
        beta = new
        if done:
            break
    return beta, weights


def density_mode(x: np.ndarray, points: int = 512) -> float:
    """Where a Gaussian kernel density with the rule-of-thumb bandwidth is highest, on a grid three bandwidths beyond the data."""
    x = np.asarray(x, float)
    if len(x) == 1:
        return float(x[0])
    q = np.quantile(x, [0.25, 0.75])
    sd = x.std(ddof=1)
    spread = min(s for s in (sd, (q[1] - q[0]) / 1.34, np.inf) if s > 0) if sd > 0 else abs(x[0]) or 1.0
    h = 0.9 * spread * len(x) ** -0.2
    grid = np.linspace(x.min() - 3 * h, x.max() + 3 * h, points)
    return float(grid[np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1).argmax()])


def tail_q_values(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """q-values of sorted distinct p-values with counts: share of nulls over the least concave majorant of the distribution."""
    p, n = np.asarray(values, float), np.asarray(counts, float)
    f = np.cumsum(n) / n.sum()
    x, y = np.concatenate([[0.0], p]), np.concatenate([[0.0], f])
    hull: list[int] = []
    for i in range(len(x)):
        while len(hull) >= 2 and (y[hull[-1]] - y[hull[-2]]) * (x[i] - x[hull[-2]]) <= (y[i] - y[hull[-2]]) * (x[hull[-1]] - x[hull[-2]]):
            hull.pop()
        hull.append(i)
    majorant = np.interp(p, x[hull], y[hull])
    upper = p > 0.5
    eta = min(1.0, n[upper].sum() / n.sum() / 0.5) if upper.any() else 1.0
    return np.minimum(1.0, np.maximum.accumulate(np.minimum(1.0, eta * p / np.maximum(majorant, 1e-300))))

"""Special functions for vectorised kernels: incomplete gamma and beta, Poisson and compound-Poisson quantiles."""

import math
from functools import cache

import numpy as np


def gamma_p(a: float, x: float) -> float:
    """Lower regularised incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * lead)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return max(0.0, 1 - lead * h)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    lead = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h


def chi2_tail(x: float, dof: float) -> float:
    return 1 - gamma_p(dof / 2, x / 2)


def t_tail(t: float, dof: float) -> float:
    """Two-sided."""
    return beta_i(dof / 2, 0.5, dof / (dof + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def poisson_mid_p(y: float, mean: float) -> float:
    """DIS1: P(X > k) + P(X = k) / 2 at k = floor(y)."""
    k = math.floor(y)
    if k < 0:
        return 1.0
    return gamma_p(k + 1, mean) + 0.5 * math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))


def poisson_mid_ps(y: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """poisson_mid_p of arrays: masses are summed upwards from k, or downwards if k lies below the mean, all rows at once."""
    k = np.floor(y)
    valid = k >= 0
    k = np.maximum(k, 0)
    log_mass = k * np.log(mean) - mean - np.array([math.lgamma(x + 1) for x in k])
    high = k >= mean
    term, total, at, live = np.ones(len(k)), np.zeros(len(k)), k.copy(), np.arange(len(k))
    while len(live):
        up = high[live]
        term[live] *= np.where(up, mean[live] / (at[live] + 1), at[live] / mean[live])
        at[live] += np.where(up, 1, -1)
        total[live] += term[live]
        live = live[(term[live] > 1e-17 * np.maximum(total[live], 1)) & (high[live] | (at[live] > 0))]
    mass = np.exp(log_mass)
    p = np.where(high, mass * (total + 0.5), 1 - mass * (total + 0.5))
    return np.where(valid, np.clip(p, 0, 1), 1.0)


def gamma_tails(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Upper regularised incomplete gamma of arrays: series below a + 1, continued fraction above, all rows at once."""
    out = np.ones(len(x))
    lead = np.exp(a * np.log(np.maximum(x, 1e-300)) - x - np.array([math.lgamma(v) for v in a]))
    low = np.flatnonzero((x > 0) & (x < a + 1))
    term = total = 1 / a[low]
    n = a[low].copy()
    while len(low) and (np.abs(term) > 1e-16 * np.abs(total)).any():
        n += 1
        term = term * x[low] / n
        total = total + term
    out[low] = 1 - np.minimum(1, total * lead[low])
    high = np.flatnonzero(x >= a + 1)
    b, c = x[high] + 1 - a[high], np.full(len(high), 1e300)
    d = 1 / b
    h = d.copy()
    for i in range(1, 10_000):
        if not len(high):
            break
        an = -i * (i - a[high])
        b = b + 2
        d = 1 / np.where(an * d + b == 0, 1e-300, an * d + b)
        c = np.where(b + an / c == 0, 1e-300, b + an / c)
        h = h * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    out[high] = lead[high] * h
    return np.clip(out, 0, 1)


def ks_p(d: float, n: int, m: int) -> float:
    """P(D > d) of two samples: by counting lattice paths below 10,000 pairs, else by Kolmogorov's series."""
    if n * m >= 10_000:
        x = d * math.sqrt(n * m / (n + m))
        if x < 0.04:
            return 1.0
        return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 200)))))
    if n < m:
        n, m = m, n
    # share[j]: of the paths to (i, j), the part that never left the band, scaled so that the last is the probability.
    share = np.array([1.0 if j / m <= d + 1e-12 else 0.0 for j in range(m + 1)])
    share = np.cumprod(share)
    for i in range(1, n + 1):
        row = np.zeros(m + 1)
        for j in range(m + 1):
            if abs(i / n - j / m) <= d + 1e-12:
                row[j] = share[j] * i / (i + j) + (row[j - 1] * j / (i + j) if j else 0.0)
        share = row
    return float(1 - share[m])


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


@cache
def t_quantile(p: float, dof: float) -> float:
    """By 200 bisections, kept: slices of one length ask for the same ones."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_tail(mid, dof) / 2 < p else (lo, mid)
    return (lo + hi) / 2


#: erfc of arrays; as exact as the scalar one.
_erfc = np.frompyfunc(math.erfc, 1, 1)


def normal_tails(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(z / math.sqrt(2)).astype(float)


def compound_poisson_tail(mean: float, shape: float):
    """P(sum > x), as a function of x > 0, of a Poisson number of lognormal pulses (mean 1, log-sd shape); each sum of k is taken as a lognormal of equal mean and variance.

    Numbers of pulses within twelve spreads of the mean count: what is left out has less than 1e-30.
    """
    reach = 12 * math.sqrt(mean)
    ks = np.arange(max(1, math.floor(mean - reach - 12)), math.ceil(mean + reach + 40) + 1)
    log_factorial = math.lgamma(ks[0] + 1) + np.concatenate([[0.0], np.cumsum(np.log(ks[1:]))])
    weights = np.exp(ks * math.log(mean) - mean - log_factorial)
    spread = np.log1p(math.expm1(shape * shape) / ks)
    centre, scale = np.log(ks) - spread / 2, np.maximum(np.sqrt(spread), 1e-12)
    return lambda x: float(weights @ normal_tails((math.log(x) - centre) / scale))


def compound_poisson_limit(mean: float, shape: float, alpha: float) -> float:
    """DIS5: the value that such a sum (see compound_poisson_tail) exceeds with probability alpha, to twelve digits; 0 for a mean of 0 or less, or where no pulse at all is likelier than 1 - alpha."""
    if not 0 < alpha < 1:
        raise ValueError("alpha lies between 0 and 1")
    if not mean > 0 or -math.expm1(-mean) <= alpha:
        return 0.0
    above = compound_poisson_tail(mean, shape)
    lo, hi = 0.0, max(1.0, 2 * mean)
    while above(hi) > alpha:
        lo, hi = hi, 2 * hi
    while hi - lo > 1e-12 * hi:
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if above(mid) > alpha else (lo, mid)
    return hi

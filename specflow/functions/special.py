"""Special functions and tails of distributions, of arrays of numbers."""

from __future__ import annotations

import math

import numpy as np


#: Coefficients of Lanczos' approximation of the gamma function, g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x):
    """ln of the gamma function of positive numbers."""
    x = np.asarray(x, float)
    small = x < 0.5
    z = np.where(small, 1 - x, x) - 1
    t = z + 7.5
    total = LANCZOS[0] + sum(c / (z + k) for k, c in enumerate(LANCZOS[1:], 1))
    out = 0.5 * math.log(2 * math.pi) + (z + 0.5) * np.log(t) - t + np.log(total)
    return np.where(small, math.log(math.pi) - np.log(np.abs(np.sin(math.pi * np.where(small, x, 0.5)))) - out, out)


def _fraction(terms, shape, eps: float = 1e-15, most: int = 20_000):
    """Continued fraction a1 / (b1 + a2 / (b2 + ...)) by Lentz's method, of all numbers at a time; a number stops when it is exact."""
    tiny = 1e-300
    f, c, d, going = np.full(shape, tiny), np.full(shape, tiny), np.zeros(shape), np.ones(shape, bool)
    for _, (a, b) in zip(range(most), terms, strict=False):
        d = b + a * d
        d = 1 / np.where(d == 0, tiny, d)
        c = b + a / c
        c = np.where(c == 0, tiny, c)
        f = np.where(going, f * c * d, f)
        going &= np.abs(c * d - 1) >= eps
        if not going.any():
            break
    return f


def gamma_upper(a, x):
    """Regularised upper incomplete gamma function."""
    shape = np.broadcast_shapes(np.shape(a), np.shape(x))
    a, x = np.broadcast_arrays(np.atleast_1d(np.asarray(a, float)), np.atleast_1d(np.asarray(x, float)))
    out = np.ones(x.shape)
    low, high = (x > 0) & (x < a + 1), (x > 0) & (x >= a + 1)
    scale = lambda at: np.exp(a[at] * np.log(x[at]) - x[at] - log_gamma(a[at]))
    if low.any():
        total = term = 1 / a[low]
        for k in range(1, 20_000):
            term = term * x[low] / (a[low] + k)
            total = total + term
            if (term <= 1e-16 * total).all():
                break
        out[low] = np.maximum(0.0, 1 - scale(low) * total)
    if high.any():
        ah, xh = a[high], x[high]

        def terms():
            yield 1.0, xh + 1 - ah
            k = 1
            while True:
                yield -k * (k - ah), xh + 2 * k + 1 - ah
                k += 1

        out[high] = scale(high) * _fraction(terms(), xh.shape)
    return out.reshape(shape)


def beta_lower(a, b, x):
    """Regularised incomplete beta function."""
    shape = np.broadcast_shapes(np.shape(a), np.shape(b), np.shape(x))
    a, b, x = np.broadcast_arrays(*(np.atleast_1d(np.asarray(v, float)) for v in (a, b, x)))
    out = (x >= 1).astype(float)
    turned = x > (a + 1) / (a + b + 2)
    a, b, y = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    inside = (x > 0) & (x < 1)
    if inside.any():
        ai, bi, yi = a[inside], b[inside], y[inside]
        scale = np.exp(ai * np.log(yi) + bi * np.log1p(-yi) + log_gamma(ai + bi) - log_gamma(ai) - log_gamma(bi)) / ai

        def terms():
            yield 1.0, 1.0
            m = 0
            while True:
                yield -(ai + m) * (ai + bi + m) * yi / ((ai + 2 * m) * (ai + 2 * m + 1)), 1.0
                m += 1
                yield m * (bi - m) * yi / ((ai + 2 * m - 1) * (ai + 2 * m)), 1.0

        found = scale * _fraction(terms(), yi.shape)
        out[inside] = np.where(turned[inside], 1 - found, found)
    return out.reshape(shape)


def chi2_tail(x, dof):
    return gamma_upper(np.asarray(dof) / 2, np.asarray(x) / 2)


def f_tail(f, d1, d2):
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return np.where(f > 0, beta_lower(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(f, 0))), 1.0)


def t_two_sided(t, dof):
    t, dof = np.asarray(t, float), np.asarray(dof, float)
    return beta_lower(dof / 2, 0.5, dof / (dof + t * t))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def kolmogorov_tail(x: float) -> float:
    """Limit distribution of the two-sample statistic."""
    return 1.0 if x < 0.2 else min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


#: Tables times cells that Fisher's test holds at once.
CELLS = 1 << 21


def fisher_two_sided(a, b, c, d):
    """Sum of the probabilities of all tables with these margins that are no likelier than this one; tables side by side, those of
    like ranges together."""
    a, b, c, d = (np.atleast_1d(np.asarray(v, float)) for v in (a, b, c, d))
    rows, cols, n = a + b, a + c, a + b + c + d
    low, high = np.maximum(0, rows + cols - n), np.minimum(rows, cols)
    choose = lambda n, k: log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)
    log_p = lambda at, k: choose(cols[at], k) + choose((n - cols)[at], rows[at] - k)
    out, order, begin = np.empty(len(a)), np.argsort(high - low, kind="stable"), 0
    while begin < len(order):
        step = max(1, int(CELLS // (1 + (high - low)[order[min(len(order), begin + 256) - 1]])))
        at = order[begin : begin + min(256, step)]
        begin += len(at)
        own, total, reference = log_p(at, a[at]), np.zeros(len(at)), choose(n[at], rows[at])
        for k0 in range(0, int((high - low)[at].max()) + 1, CELLS):  # more only for a table of millions
            k = low[at][:, None] + np.arange(k0, min(k0 + CELLS, int((high - low)[at].max()) + 1))
            there = k <= high[at][:, None]
            logs = log_p(at[:, None], np.where(there, k, low[at][:, None]))
            total += np.where(there & (logs <= own[:, None] + 1e-7), np.exp(logs - reference[:, None]), 0).sum(1)
        out[at] = np.minimum(1.0, total)
    return out if len(out) > 1 else float(out[0])


def mann_whitney_exact(u: int, n1: int, n2: int) -> float:
    """Two-sided p of U without ties, by counting."""
    counts = [1] + [0] * (n1 * n2)
    for i in range(1, n1 + 1):  # Gaussian binomial coefficient, factor by factor
        for j in range(n1 * n2, n2 + i - 1, -1):
            counts[j] -= counts[j - n2 - i]
        for j in range(i, n1 * n2 + 1):
            counts[j] += counts[j - i]
    u = min(u, n1 * n2 - u)
    return min(1.0, 2 * sum(counts[: u + 1]) / sum(counts))

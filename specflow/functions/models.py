"""Models of one small table of features, in numpy: mixtures, hierarchies, spectra, densities, a kernel classifier.

They hold all rows of a table in one worker and are at least quadratic in them where a matrix of distances is needed. A feature
table has one row for a curve; ``LARGEST`` bounds what is accepted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

LARGEST = 20_000


def checked(x: np.ndarray) -> np.ndarray:
    if len(x) > LARGEST:
        raise ValueError(f"{len(x)} rows; these models take {LARGEST} at most")
    return np.asarray(x, float)


def distances(x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    y = x if y is None else y
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T))


@dataclass
class Mixture:
    """Gaussian mixture with full covariances."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        out = []
        for w, m, c in zip(self.weights, self.means, self.covariances, strict=True):
            root = np.linalg.cholesky(c)
            z = np.linalg.solve(root, (x - m).T)
            out.append(math.log(max(w, 1e-300)) - 0.5 * ((z * z).sum(0) + x.shape[1] * math.log(2 * math.pi)) - np.log(np.diag(root)).sum())
        return np.stack(out, 1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        p = self.log_parts(x)
        p = np.exp(p - p.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.log_parts(x).argmax(1)

    @property
    def parameters(self) -> int:
        k, d = self.means.shape
        return k * d + k * d * (d + 1) // 2 + k - 1

    def bic(self, n: int) -> float:
        return -2 * self.log_likelihood + self.parameters * math.log(n)

    def aic(self) -> float:
        return -2 * self.log_likelihood + 2 * self.parameters


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 100) -> np.ndarray:
    """Labels; centres begin spread out by squared distance."""
    centres = x[[rng.integers(len(x))]]
    while len(centres) < k:
        d = (distances(x, centres) ** 2).min(1)
        centres = np.vstack([centres, x[rng.choice(len(x), p=d / d.sum() if d.sum() else None)]])
    for _ in range(rounds):
        labels = distances(x, centres).argmin(1)
        new = np.array([x[labels == j].mean(0) if (labels == j).any() else centres[j] for j in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    return labels


def mixture(x: np.ndarray, k: int, starts: int = 10, seed: int = 42, rounds: int = 200, floor: float = 1e-6) -> Mixture:
    """Best of several runs of expectation and maximisation."""
    x, best = checked(x), None
    n, d = x.shape
    for s in range(starts):
        r = np.eye(k)[kmeans(x, k, np.random.default_rng([seed, s]))]
        last = -math.inf
        for _ in range(rounds):
            size = r.sum(0) + 1e-10
            means = r.T @ x / size[:, None]
            cov = np.array([(r[:, j, None] * (x - means[j])).T @ (x - means[j]) / size[j] + floor * np.eye(d) for j in range(k)])
            m = Mixture(size / n, means, cov, 0.0)
            p = m.log_parts(x)
            top = p.max(1, keepdims=True)
            total = top[:, 0] + np.log(np.exp(p - top).sum(1))
            m.log_likelihood = float(total.sum())
            r = np.exp(p - total[:, None])
            if m.log_likelihood - last < 1e-3 * n * 1e-3:
                break
            last = m.log_likelihood
        if best is None or m.log_likelihood > best.log_likelihood:
            best = m
    return best


def mixture_by_bic(x: np.ndarray, most: int, starts: int = 10, seed: int = 42, least: int = 2) -> Mixture:
    """Fewest parts first; the lowest BIC wins."""
    made = [mixture(x, k, starts, seed) for k in range(least, max(least, most) + 1)]
    return min(made, key=lambda m: m.bic(len(x)))


def chained(x: np.ndarray, w: np.ndarray, bound=None) -> list[tuple[int, int, float, int]]:
    """Ward's merges (a, b, squared height, number of the new cluster) of weighted points, by chains of nearest neighbours. With a bound, which
    gives for centres and weights what the squared height to anything else is at least, only merges that are below it on both sides."""
    n = len(x)
    centre, size, number = np.array(x, float), np.array(w, float), np.arange(n)
    alive, stuck = np.ones(n, bool), np.zeros(n, bool)
    limit = np.full(n, np.inf) if bound is None else bound(centre, size)
    merges, chain, left, new = [], [], n, n
    while left > 1:
        if not chain:
            free = np.nonzero(alive & ~stuck)[0]
            if not len(free):
                break
            chain = [int(free[0])]
        i = chain[-1]
        gap = 2 * size[i] * size / (size[i] + size) * ((centre - centre[i]) ** 2).sum(1)
        gap[~alive] = np.inf
        gap[i] = np.inf
        j = int(gap.argmin())
        if gap[j] > limit[i] or stuck[j]:
            stuck[chain], chain = True, []
            continue
        if len(chain) > 1 and gap[chain[-2]] <= gap[j]:
            j = chain[-2]
            chain = chain[:-2]
            merges.append((int(number[i]), int(number[j]), float(gap[j]), new))
            total = size[i] + size[j]
            c = (size[i] * centre[i] + size[j] * centre[j]) / total
            alive[[i, j]] = False
            keep = np.nonzero(alive)[0] if 2 * (left - 1) < len(alive) else slice(None)
            if not isinstance(keep, slice):  # what is gone takes no time from here
                at = np.cumsum(alive) - 1
                chain = [int(at[v]) for v in chain]
            row = (centre, c[None]), (size, [total]), (number, [new]), (alive, [True]), (stuck, [False]), (limit, [np.inf] if bound is None else bound(c[None], np.array([total])))
            centre, size, number, alive, stuck, limit = (np.concatenate([old[keep], one]) for old, one in row)
            left, new = left - 1, new + 1
        else:
            chain.append(j)
    return merges


def ward(x: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """Linkage (a, b, height, weight) by chains of nearest neighbours, in ascending height; w: how many rows a point stands for."""
    x = checked(x)
    n = len(x)
    size = np.ones(n) if w is None else np.asarray(w, float)
    merges = [(a, b, math.sqrt(h)) for a, b, h, _ in chained(x, size)]
    size = size.tolist()
    for a, b, _ in merges:
        size.append(size[a] + size[b])
    order = sorted(range(len(merges)), key=lambda m: (merges[m][2], m))
    new = {n + m: n + rank for rank, m in enumerate(order)}
    return np.array([(*sorted(new.get(v, v) for v in merges[m][:2]), merges[m][2], size[n + m]) for m in order])


def cut(linkage: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters, numbered in order of their first row."""
    n = len(linkage) + 1
    parent = list(range(2 * n))
    for i, (a, b, *_) in enumerate(linkage[: n - k]):
        parent[int(a)] = parent[int(b)] = n + i

    def top(v: int) -> int:
        while parent[v] != v:
            v = parent[v]
        return v

    seen: dict[int, int] = {}
    return np.array([seen.setdefault(top(i), len(seen)) for i in range(n)])


def spectral(x: np.ndarray, k: int, gamma: float = 1.0, seed: int = 42) -> np.ndarray:
    """k-means on the leading eigenvectors of a normalised Gaussian affinity."""
    a = np.exp(-gamma * distances(checked(x)) ** 2)
    root = 1 / np.sqrt(a.sum(1))
    _, vectors = np.linalg.eigh(root[:, None] * a * root[None])
    return kmeans(vectors[:, -k:] * root[:, None], k, np.random.default_rng(seed))


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    d, kinds = distances(x), np.unique(labels)
    if len(kinds) < 2:
        return 0.0
    mean = np.stack([d[:, labels == k].sum(1) for k in kinds], 1)
    size = np.array([(labels == k).sum() for k in kinds])
    own = np.searchsorted(kinds, labels)
    rows = np.arange(len(x))
    a = mean[rows, own] / np.maximum(1, size[own] - 1)
    other = mean / size
    other[rows, own] = np.inf
    b = other.min(1)
    return float(np.where(size[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0).mean())


def davies_bouldin(x: np.ndarray, labels: np.ndarray) -> float:
    kinds = np.unique(labels)
    centres = np.array([x[labels == k].mean(0) for k in kinds])
    spread = np.array([np.sqrt(((x[labels == k] - c) ** 2).sum(1)).mean() for k, c in zip(kinds, centres, strict=True)])
    gap = distances(centres)
    np.fill_diagonal(gap, np.inf)
    return float(((spread[:, None] + spread[None]) / gap).max(1).mean())


def hdbscan(x: np.ndarray, least_size: int = 5, samples: int = 2) -> np.ndarray:
    """Density clusters by excess of mass; -1 is noise. Mutual reachability, a spanning tree, a condensed tree, stability."""
    x = checked(x)
    n, d = len(x), distances(checked(x))
    if n < 2 * least_size:
        return np.full(n, -1)
    core = np.sort(d, axis=1)[:, min(samples, n - 1)]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    inside, near, frm = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    edges, v = [], 0
    for _ in range(n - 1):  # Prim's algorithm
        inside[v] = True
        closer = ~inside & (reach[v] < near)
        near[closer], frm[closer] = reach[v][closer], v
        v = int(np.where(inside, np.inf, near).argmin())
        edges.append((near[v], frm[v], v))
    group, children, height = list(range(n)), {}, {}
    members = {i: [i] for i in range(n)}

    def find(a: int) -> int:
        while group[a] != a:
            group[a] = group[group[a]]
            a = group[a]
        return a

    top = {i: i for i in range(n)}
    for w, a, b in sorted(edges):
        ra, rb, node = find(a), find(b), n + len(height)
        children[node], height[node] = (top[ra], top[rb]), w
        members[node] = members[top[ra]] + members[top[rb]]
        group[ra] = rb
        top[rb] = node

    def best(node: int, born: float) -> tuple[float, list[int]]:
        """Stability and clusters below a cluster that begins at a density."""
        stability, at = 0.0, node
        while True:
            if at < n:
                return stability, [node]
            dense = 1 / max(height[at], 1e-12)
            a, b = children[at]
            big = [c for c in (a, b) if len(members[c]) >= least_size]
            if len(big) == 2:
                stability += len(members[at]) * (dense - born)
                parts = [best(c, dense) for c in big]
                below = sum(p[0] for p in parts)
                return (below, parts[0][1] + parts[1][1]) if below > stability else (stability, [node])
            gone = len(members[at]) - (len(members[big[0]]) if big else 0)
            stability += gone * (dense - born)
            if not big:
                return stability, [node]
            at = big[0]

    root = n + len(height) - 1
    a, b = children[root]
    big = [c for c in (a, b) if len(members[c]) >= least_size]
    while len(big) == 1 and big[0] >= n:
        a, b = children[big[0]]
        big = [c for c in (a, b) if len(members[c]) >= least_size]
    labels = np.full(n, -1)
    clusters = [c for part in big for c in best(part, 0.0)[1]] if len(big) == 2 else []
    for k, c in enumerate(clusters):
        labels[members[c]] = k
    return labels


def assignment(gain: np.ndarray) -> list[int]:
    """Column for each row so that the sum is greatest (Kuhn-Munkres with potentials); rows no more than columns."""
    cost = gain.max() - gain
    n, m = cost.shape
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0, least, used, way = i, 0, [math.inf] * (m + 1), [False] * (m + 1), [0] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], math.inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    now = cost[i0 - 1, j - 1] - u[i0] - v[j]
                    if now < least[j]:
                        least[j], way[j] = now, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def aligned(reference: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Labels renamed to overlap most with the reference; those without a partner get new numbers."""
    a, b = np.unique(reference), np.unique(labels)
    overlap = np.array([[np.sum((labels == y) & (reference == x)) for x in a] for y in b], float)
    wide = np.zeros((len(b), max(len(a), len(b))))
    wide[:, : len(a)] = overlap
    names, fresh, new = assignment(wide), int(a.max()) + 1, {}
    for y, j in zip(b, names, strict=True):
        if j < len(a):
            new[y] = int(a[j])
        else:
            new[y], fresh = fresh, fresh + 1
    return np.array([new[y] for y in labels])


def adjusted_rand(a: np.ndarray, b: np.ndarray) -> float:
    table = np.array([[np.sum((a == x) & (b == y)) for y in np.unique(b)] for x in np.unique(a)], float)
    two = lambda n: float((n * (n - 1) / 2).sum())
    both, rows, cols, n = two(table), two(table.sum(1)), two(table.sum(0)), len(a) * (len(a) - 1) / 2
    chance = rows * cols / n if n else 0
    return 1.0 if (rows + cols) / 2 == chance else (both - chance) / ((rows + cols) / 2 - chance)


@dataclass
class KernelClassifier:
    """Two-class support vector machine with a Gaussian kernel, by sequential minimal optimisation."""

    points: np.ndarray
    weights: np.ndarray
    bias: float
    gamma: float

    def decide(self, x: np.ndarray) -> np.ndarray:
        return np.exp(-self.gamma * distances(x, self.points) ** 2) @ self.weights + self.bias


def kernel_classifier(x: np.ndarray, y: np.ndarray, c: float = 1.0, gamma: float | None = None, rounds: int = 20_000, eps: float = 1e-3) -> KernelClassifier:
    """y: -1 or 1. The pair that violates the conditions most moves each round."""
    x = checked(x)
    gamma = gamma or 1 / max(1e-12, x.shape[1] * x.var())
    k, alpha, grad = np.exp(-gamma * distances(x) ** 2), np.zeros(len(x)), -np.ones(len(x))
    for _ in range(rounds):
        up = ((y > 0) & (alpha < c)) | ((y < 0) & (alpha > 0))
        low = ((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < c))
        i, j = int(np.where(up, -y * grad, -np.inf).argmax()), int(np.where(low, -y * grad, np.inf).argmin())
        gap = -y[i] * grad[i] + y[j] * grad[j]
        if gap < eps:
            break
        step = gap / max(1e-12, k[i, i] + k[j, j] - 2 * k[i, j])
        room_i = c - alpha[i] if y[i] > 0 else alpha[i]
        room_j = alpha[j] if y[j] > 0 else c - alpha[j]
        step = min(step, room_i, room_j)
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        grad += y * (k[:, i] - k[:, j]) * step
    free = (alpha > 1e-8) & (alpha < c - 1e-8)
    bias = float((-y * grad)[free].mean()) if free.any() else float((np.where(up, -y * grad, -np.inf).max() + np.where(low, -y * grad, np.inf).min()) / 2)
    keep = alpha > 1e-8
    return KernelClassifier(x[keep], (alpha * y)[keep], bias, gamma)


def shapiro(values: np.ndarray) -> tuple[float, float]:
    """Shapiro-Wilk W and p by Royston's approximation, for 4 to 5,000 values."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 4 or x[0] == x[-1]:
        return 1.0, 1.0
    from statistics import NormalDist

    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    size, u = float(m @ m), 1 / math.sqrt(n)
    poly = lambda c, t: sum(a * t**k for k, a in enumerate(c))
    w = m / math.sqrt(size)
    last = poly([w[-1], 0.221157, -0.147981, -2.071190, 4.434685, -2.706056], u)
    if n > 5:
        second = poly([w[-2], 0.042981, -0.293762, -1.752461, 5.682633, -3.582633], u)
        w = m / math.sqrt((size - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2))
        w[-2], w[1] = second, -second
    else:
        w = m / math.sqrt((size - 2 * m[-1] ** 2) / (1 - 2 * last**2))
    w[-1], w[0] = last, -last
    stat = float((w @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    ln = math.log(n)
    if n <= 11:
        mu, sigma = poly([0.5440, -0.39978, 0.025054, -6.714e-4], n), math.exp(poly([1.3822, -0.77857, 0.062767, -0.0020322], n))
        z = (-math.log(max(1e-12, poly([-2.273, 0.459], n) - math.log(max(1e-300, 1 - stat)))) - mu) / sigma
    else:
        mu, sigma = poly([-1.5861, -0.31082, -0.083751, 0.0038915], ln), math.exp(poly([-0.4803, -0.082676, 0.0030302], ln))
        z = (math.log(max(1e-300, 1 - stat)) - mu) / sigma
    return stat, 0.5 * math.erfc(z / math.sqrt(2))


def density(points: np.ndarray, grid: np.ndarray, width: float | None = None) -> np.ndarray:
    """Gaussian kernel density; the default width is Scott's."""
    h = (width or len(points) ** (-1 / 5)) * points.std(ddof=1)
    return np.exp(-0.5 * ((grid[:, None] - points[None]) / h) ** 2).sum(1) / (len(points) * h * math.sqrt(2 * math.pi))


def ellipse(cov: np.ndarray, deviations: float = 2.0) -> tuple[float, float, float]:
    """Width, height and angle in degrees of a confidence ellipse."""
    values, vectors = np.linalg.eigh(cov)
    return 2 * deviations * math.sqrt(values[1]), 2 * deviations * math.sqrt(values[0]), math.degrees(math.atan2(vectors[1, 1], vectors[0, 1]))

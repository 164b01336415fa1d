"""Neighbours of all rows, smoothing as columns and cluster quality against plain loops."""

import math

import numpy as np
import pytest

from specflow.functions import fit
from specflow.operators import curves, neighbours, statistics
from specflow.operators.cells import Cells


def scattered():
    rng = np.random.default_rng(2)
    parts = [rng.normal(0, 1, (2000, 2)), rng.normal([30, 30], 0.001, (1500, 2)), rng.uniform(-1e4, 1e4, (200, 2)), np.full((1200, 2), [3.0, -2.0]), np.round(rng.normal(0, 2, (100, 2)))]
    x = np.concatenate(parts)
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("options", [{}, {"block": 64, "sample": 900}])
def test_nearest_of_all(spark, options):
    x, k = scattered(), 3
    rows = [(i, float(a), float(b), 0) for i, (a, b) in enumerate(x)] + [(9000, None, 1.0, 0), (9001, math.nan, 1.0, 0), (9002, math.inf, 1.0, 0), (None, 1.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, q int").repartition(5)
    got = {}
    for r in neighbours.nearest_of_all(df, "id", ["a", "b"], k, **options).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["id"], r["distance"]))
    assert len(got) == len(x)
    for i in range(len(x)):
        d = ((x - x[i]) ** 2)[:, 0] + ((x - x[i]) ** 2)[:, 1]
        d[i] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:k]
        assert [(r, j) for r, j, _ in sorted(got[i])] == [(n + 1, int(j)) for n, j in enumerate(best)]
        assert np.allclose([v for *_, v in sorted(got[i])], np.sqrt(d[best]))
    few = neighbours.nearest_of_all(df.where("id < 2"), "id", ["a", "b"], k)
    assert sorted((r["query"], r["id"], r["rank"]) for r in few.collect()) == [(0, 1, 1), (1, 0, 1)]
    assert neighbours.nearest_of_all(df.limit(0), "id", ["a", "b"], k).count() == 0


def test_only_near_cells_meet():
    x = np.random.default_rng(1).uniform(0, 1, (20_000, 2))
    cell = Cells(x, 200).of(x)
    size = np.bincount(cell)[np.unique(cell)]
    assert len(size) == 200 and size.max() <= 2 * size.min() + 2
    assert neighbours.reach(np.array([[0.0], [1.0], [3.0]]), np.array([1, 2, 1]), 2).tolist() == [1.0, 1.0, 4.0]


def test_smoothing_as_columns(spark):
    rng = np.random.default_rng(4)
    made = {g: rng.normal(0, 1, n) for g, n in (("a", 40), ("b", 11), ("c", 7), ("d", 6), ("e", 1), ("f", 8))}
    df = spark.createDataFrame([(g, i, float(v)) for g, y in made.items() for i, v in enumerate(y)], "g string, i int, y double").repartition(3)
    for window in (7, 11):
        got = {}
        for r in curves.smoothed(df, "g", ["i"], "y", "s", window).orderBy("i").collect():
            got.setdefault(r["g"], []).append(r["s"])
        assert got.keys() == made.keys() and all(np.allclose(got[g], fit.savgol(y, window)) for g, y in made.items())
    plan = curves.smoothed(df, "g", ["i"], "y", "s")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "unboundedfollowing" not in plan.lower()


def test_cluster_quality(spark):
    rng = np.random.default_rng(5)
    g = np.array([0] * 30 + [1] * 20 + [2] * 5 + [3])
    x = rng.normal(0, 1, (len(g), 3)) + g[:, None]
    df = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, g))] + [(99, None, 1), (98, [1.0, 1.0, 1.0], None)], "i int, v array<double>, g int")
    d = ((x[:, None] - x) ** 2).sum(2)
    each = []
    for i in range(len(g)):
        own = d[i, g == g[i]].sum() / max(1, (g == g[i]).sum() - 1)
        other = min(d[i, g == h].mean() for h in set(g) - {g[i]})
        each.append(0.0 if (g == g[i]).sum() == 1 else (other - own) / max(own, other))
    assert math.isclose(statistics.squared_silhouette(df, "v", "g", 3).first()[0], np.mean(each), rel_tol=1e-9)
    m = np.array([x[g == h].mean(0) for h in range(4)])
    s = np.array([np.sqrt(((x[g == h] - m[h]) ** 2).sum(1)).mean() for h in range(4)])
    want = np.mean([max((s[i] + s[j]) / np.sqrt(((m[i] - m[j]) ** 2).sum()) for j in range(4) if j != i) for i in range(4)])
    assert math.isclose(statistics.davies_bouldin(df, "v", "g", 3).first()[0], want, rel_tol=1e-9)
    assert statistics.davies_bouldin(df.where("g = 1"), "v", "g", 3).first()[0] is None and statistics.squared_silhouette(df.limit(0), "v", "g", 3).first()[0] is None
    # by distances that are not squared the quadratic form says nearly the same of these clusters
    assert abs(statistics.silhouette(df.where("v is not null and g is not null"), "i", "v", "g").first()[0] - np.mean(each)) < 0.3


def test_runs_and_their_tail_equal_the_kernel(spark):
    rng = np.random.default_rng(8)
    made = {}
    for g, width in (("a", 80.0), ("b", 140.0), (None, 60.0)):
        e = np.sort(rng.uniform(2.05, 2.32, 60))
        made[g] = (e, np.log(np.exp((e - 2.4) / (width / 1000)) * np.exp(rng.normal(0, 0.02, len(e)))))
    df = spark.createDataFrame([(g, float(x), float(y)) for g, (e, v) in made.items() for x, y in zip(e, v)], "g string, x double, y double").repartition(3)
    runs = curves.run_fits(df, "g", "x", "y", narrow=0.12, wide=0.28, least=12)
    got = {}
    for r in runs.collect():
        got.setdefault(r["g"], {})[r["i"] - 1, r["j"] - 1] = (r["r2"], r["slope"], r["intercept"], r["error"])
    tails = {r["g"]: r for r in curves.tail_of_runs(runs, "g").collect()}
    for g, (e, v) in made.items():
        lines, n = fit.Lines(e, v), len(e)
        pairs = [(i, j) for i in range(n) for j in range(i + 12, n) if 0.12 <= e[j] - e[i] <= 0.28]
        assert sorted(got[g]) == pairs
        i, j = np.array(pairs).T
        assert np.allclose(np.array([got[g][p] for p in pairs]), np.stack(lines.fit(i, j + 1), 1), rtol=1e-6, atol=1e-9)
        r2, slope, _, error = lines.fit(i, j + 1)
        with np.errstate(divide="ignore"):
            width = np.where(slope > 0, 1000 / slope, np.inf)
        keep = (slope > 0) & (r2 >= 0.97) & (width >= 15) & (width <= 800)
        score = (r2 - 0.15 * error)[keep]
        near = width[keep][score >= score.max() - 0.005]
        assert math.isclose(tails[g]["width"], np.median(near), rel_tol=1e-6) and tails[g]["runs"] == len(near)


def test_permutations_in_chunks(spark):
    rng = np.random.default_rng(3)
    g = np.array(["a"] * 40 + ["b"] * 25 + ["c"] * 30 + ["one"])
    v = rng.normal(0, 1, len(g)) + 0.35 * (g == "b")
    df = spark.createDataFrame([(str(a), float(b)) for a, b in zip(g, v)] + [("a", None), (None, 1.0)], "g string, v double").repartition(4)
    many = [statistics.permutation_f(df, "g", "v", 1500, chunk=chunk) for chunk in (10_000, 17)]
    w, h = v[g != "one"], g[g != "one"]
    f = lambda x: sum(x[h == k].sum() ** 2 / (h == k).sum() for k in "abc") - x.sum() ** 2 / len(x)
    plain = np.mean([f(rng.permutation(w)) >= f(w) for _ in range(3000)])
    assert 0.01 < plain < 0.9 and all(abs(p - plain) < 0.05 for p in many)
    assert statistics.permutation_f(df.where("g = 'a'"), "g", "v", 10) == 1.0


def plain_line(x, y):
    slope, intercept = np.polyfit(x, y, 1)
    return np.corrcoef(x, y)[0, 1] ** 2, slope, intercept


def plain_legacy(x, y):
    """The older search, point by point: start and end (inclusive) and whether it crosses high enough."""
    n, size = len(x), max(5, int(0.25 * len(x)))
    line = lambda i, j: plain_line(x[i : j + 1], y[i : j + 1])
    windows = sorted((-line(i, i + size - 1)[0], i) for i in range(n - size + 1) if line(i, i + size - 1)[1] > 0.1)

    def search(i, gap):
        j, cap, go = i + size - 1, int(0.4 * n), True
        fine = lambda i, j: (r := line(i, j))[0] >= 0.997 and r[1] > 0.1 and -r[2] / r[1] >= gap
        while go and j - i + 1 < cap:
            go = False
            if j < n - 1 and fine(i, j + 1):
                j, go = j + 1, True
            if i > 0 and j - i + 1 < cap and fine(i - 1, j):
                i, go = i - 1, True
        cut = max(0, min(max(2, int(0.05 * (j - i + 1))), (j - i + 1 - 5) // 2))
        return i + cut, j - cut

    for _, start in windows:
        i, j = search(start, 1.8)
        r = line(i, j)
        if r[1] > 0 and -r[2] / r[1] >= 1.8:
            return i, j, True
    return (*search(windows[0][1], 0.0), False) if windows else None


def test_older_search_and_refined_ends():
    rng = np.random.default_rng(11)
    kinds = set()
    for shift in (2.4, 2.0, 1.2, 0.6, -1.0):
        for noise in (0.0005, 0.01):
            x = np.sort(rng.uniform(1.2, 3.6, 90))
            y = np.maximum(0, 3 * (x - shift)) + 0.3 * np.minimum(0, 3.1 - x) * 3 + rng.normal(0, noise, len(x))
            found, want = fit.legacy_edge(x, y), plain_legacy(x, y)
            assert (found.start, found.stop - 1, found.confidence != "invalid") == want
            kinds.add(found.confidence)
    assert {"invalid", "high"} <= kinds and fit.legacy_edge(x, -x) is None and fit.legacy_edge(x[:3], x[:3]) is None
    x = np.linspace(2, 3, 41)
    y = np.where(x < 2.2, 0.4 * (x - 2.2), np.where(x > 2.9, 0.7 + 0.2 * (x - 2.9), x - 2.2))
    i, j = fit.refined(fit.Lines(x, y), 0, 41)
    a, b, slope = 0, 40, plain_line(x, y)[1]
    while b - a + 1 > 22 and (s := plain_line(x[a + 1 : b + 1], y[a + 1 : b + 1])[1]) > 1.005 * slope:
        a, slope = a + 1, s
    while b - a + 1 > 22 and (s := plain_line(x[a:b], y[a:b])[1]) > 1.005 * slope:
        b, slope = b - 1, s
    assert (i, j - 1) == (a, b) and a > 0 and fit.refined(fit.Lines(x, y), 3, 9) == (3, 9)

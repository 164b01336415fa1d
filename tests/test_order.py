"""Order statistics over ranges, and tails of whole batches."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from specflow.functions import special
from specflow.operators import order, statistics


def values(spark):
    rng = random.Random(5)
    rows = [("hot", float(rng.randint(0, 400)), 1) for _ in range(1500)] + [(f"g{i % 40}", rng.random(), 1) for i in range(300)] + [(None, float(i), 1) for i in range(5)]
    rows += [("one", 2.0, 1), ("hot", None, 1), ("hot", float("nan"), 1), ("none", None, 1)]
    return rows, spark.createDataFrame(rows, "g string, v double, _n int").repartition(4)


def test_quantiles_of_groups(spark):
    rows, df = values(spark)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: (r["n"], r["q"]) for r in order.group_quantiles(df, ["g"], "v", shares).collect()}
    groups = {}
    for g, v, _ in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(g, []).append(v)
    assert got.keys() == groups.keys()
    for g, v in groups.items():
        assert got[g][0] == len(v) and np.allclose(got[g][1], np.quantile(v, shares))
    held = order.ranged(df.where("v is not null").groupBy("g", "v").count(), "g", "v")
    assert held.where("g = 'hot'").select("_range").distinct().count() > 1
    assert order.group_quantiles(df.limit(0), ["g"], "v", shares).count() == 0


def test_running_sums_of_groups(spark):
    rows, df = values(spark)
    counts = df.where("v is not null and not isnan(v)").groupBy("g", "v").agg(F.count("*").alias("n"))
    got = {(r["g"], r["v"]): r["n"] for r in order.running(counts, "v", ["n"], ["g"]).collect()}
    good = [(g, v) for g, v, _ in rows if v is not None and not math.isnan(v)]
    assert got == {(g, v): sum(h == g and w <= v for h, w in good) for g, v in set(good)}


def test_adjusted_and_numbered(spark):
    rng = random.Random(1)
    p = [round(rng.random() ** 3, 2) for _ in range(200)] + [None, 0.0, 1.0]
    got = {r["i"]: r["p_adj"] for r in statistics.adjusted(spark.createDataFrame(list(enumerate(p)), "i int, p double").repartition(3), "p").collect()}
    known = sorted((v, i) for i, v in enumerate(p) if v is not None)
    raw = {v: v * len(known) / sum(w <= v for w, _ in known) for v, _ in known}
    for i, v in enumerate(p):
        assert (got[i] is None) == (v is None) and (v is None or math.isclose(got[i], min(1.0, min(r for w, r in raw.items() if w >= v)), abs_tol=1e-12))
    names = [f"t{i}" for i in range(50)]
    rng.shuffle(names)
    numbered = order.numbered(spark.createDataFrame([(n,) for n in names], "t string").repartition(4), "t", "k")
    assert {r["t"]: r["k"] for r in numbered.collect()} == {n: i + 1 for i, n in enumerate(sorted(names))}


def test_tails_of_batches(spark):
    x = np.array([0.0, 0.5, 3.84, 50.0, 2000.0])
    assert np.allclose(special.chi2_tail(x, 2), np.exp(-x / 2)) and math.isclose(special.chi2_tail(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    t = np.array([0.0, 1.0, 12.706204736432095])
    assert np.allclose(special.t_two_sided(t, 1), 1 - 2 / math.pi * np.arctan(t))
    assert np.allclose(special.log_gamma([0.1, 1, 7.5, 1e6]), [math.lgamma(v) for v in (0.1, 1, 7.5, 1e6)])
    tables = np.random.default_rng(0).integers(0, 25, (60, 4))

    def fisher(a, b, c, d):
        ways = lambda k: math.comb(a + c, k) * math.comb(b + d, a + b - k)
        every = [ways(k) for k in range(max(0, a + b - b - d), min(a + b, a + c) + 1)]
        return sum(w for w in every if w <= ways(a) * (1 + 1e-7)) / sum(every)

    assert np.allclose(special.fisher_two_sided(*tables.T), [fisher(*map(int, r)) for r in tables])
    df = spark.createDataFrame([(1, 3.0, 2.0), (2, None, 2.0), (3, 1.0, 2.0)], "i int, x double, d double")
    assert {r["i"]: r["p"] and round(r["p"], 9) for r in df.select("i", statistics.tail("chi2_tail", F.col("x"), F.col("d")).alias("p")).collect()} == {1: round(math.exp(-1.5), 9), 2: None, 3: round(math.exp(-0.5), 9)}

"""Hard negatives against all products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from specflow.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, x int, slot string"


def brute(rows, anchor, k=5):
    use = [(r[0], r[2], [math.floor(256 * float(np.float32(c))) for c in r[1]]) for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    out = []
    for i, label, x in use:
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j, m == label) for j, m, y in use if j != i)
        for s, j, _ in [z for z in scored if z[2]][:k]:
            fits = [z for z in scored if not z[2] and 80 * -s <= 100 * -z[0] <= 100 * -s][:k]
            out += [(i, j, r + 1, z[1], -s, -z[0]) for r, z in enumerate(fits)]
    return sorted(out)


def vectors(n, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (4, dims))
    rows = []
    for i in range(n):
        v = centres[i % 4] + rng.normal(0, 0.4, dims)
        rows.append((i, [float(c) for c in v / np.linalg.norm(v)], int(rng.integers(0, 5)), 1, "s"))
    return rows


@pytest.mark.parametrize("options", [{}, {"chunk": 7, "sample": 40}])
def test_all_products(spark, options):
    rows = vectors(600)
    same = rows[3][1]
    rows = [(r[0], same, *r[2:]) if r[0] % 3 == 1 else r for r in rows]  # a third is one vector
    rows += [(600, None, 1, 1, "s"), (700, same, None, 1, "s"), (800, [float("nan"), *same[1:]], 1, 1, "s"), (900, [None, *same[1:]], 1, 1, "s"), (None, same, 1, 1, "s"), (1000, same[:9], 1, 1, "s"), (1100, [], 1, 1, "s")]
    rows += [rows[0], rows[7], rows[7]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = negatives.mine(df, F.col("vec_id") % 20 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 20 == 0)


def test_bounds_discard_most_pairs_and_lose_none():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(0, 1, (900, 32)) * np.linspace(3, 0.02, 32)).astype(np.int64)
    rotation, levels = negatives.learned(x[:300])
    rows, anchors = negatives.Rotated(x, rotation, levels), negatives.Rotated(x[:50], rotation, levels)
    exact = x @ x[:50].T
    need = np.sort(exact, 0)[-5]
    i, j = negatives.survivors(rows, anchors, levels, need, np.full(50, np.inf))
    assert {*zip(i.tolist(), j.tolist())} >= {*zip(*(a.tolist() for a in np.nonzero(exact >= need)))} and len(i) < 0.02 * exact.size
    assert levels[0] < 16 and (negatives.products(x, i, x[:50], j) == exact[i, j]).all()


def test_negative_scores_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0], 1, 1, ""), (1, [-1.0, 0.0], 1, 1, ""), (2, [-0.9, 0.0], 2, 1, ""), (3, [0.0, 0.0], 1, 1, ""), (4, [0.0, 1.0], 2, 1, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, negatives.mine(df, F.col("vec_id") == 0).collect())) == brute(rows, lambda i: i == 0) == [(0, 3, 1, 4, 0, 0)]
    assert negatives.mine(df.limit(0), F.col("vec_id") == 0).count() == 0 and negatives.mine(df, F.lit(None).cast("boolean")).count() == 0

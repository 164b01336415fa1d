"""The nearest rows of stated queries, against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from specflow.operators import statistics


def brute(rows, k=5):
    out = []
    for q, x in rows:
        if q % 7 == 0:
            far = [(0, math.dist(x, y), i) if x is not None and y is not None else (1, 0.0, i) for i, y in rows if i != q]
            out += [(q, i, None if none else round(d, 9), r + 1) for r, (none, d, i) in enumerate(sorted(far)[:k])]
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = statistics.nearest(df.where("id % 7 = 0"), df, "id", "v").select("query", "id", F.round("distance", 9), "rank")
    return sorted(tuple(r) for r in got.collect())


def test_blocks_of_queries_and_rows(spark, monkeypatch):
    for name, value in (("QUERY_BLOCK", 10), ("ROW_BLOCK", 60), ("TILE", 300), ("STEP", 50), ("LOOK", 20)):
        monkeypatch.setattr(statistics, name, value)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(200)] + [(200 + i, [float(i % 3)] * 6) for i in range(100)]
    assert found(spark, rows) == brute(rows)


def test_null_vectors_come_last(spark):
    rows = [(i, None if i % 3 == 0 else [float(i), 0.0]) for i in range(9)]
    assert found(spark, rows) == brute(rows)


def test_large_groups_of_copies(spark, monkeypatch):
    monkeypatch.setattr(statistics, "ROW_BLOCK", 500)
    rows = [(i, [1.0, 2.0]) for i in range(3000)] + [(3000 + i, [1e9 + i, 2.0]) for i in range(10)]
    got = found(spark, rows)
    assert len(got) == 5 * sum(i % 7 == 0 for i, _ in rows)
    by_rank = lambda q: [r[1] for r in sorted(got, key=lambda r: r[3]) if r[0] == q]
    assert by_rank(0) == [1, 2, 3, 4, 5] and by_rank(3003) == [3002, 3004, 3001, 3005, 3000]

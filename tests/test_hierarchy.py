"""Nested clusters spread over tasks, against those of one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from specflow.functions import models
from specflow.operators import clusters, hierarchy

SCHEMA = "sample_id string, E_g_eV double, E_u_meV double, A_sub double, A_sub_coverage double"


def table(spark, n, copies=1):
    rng = np.random.default_rng(0)
    made = [(2.4 + 0.3 * (i % 2) + 0.02 * rng.normal(), 200 + 10 * rng.normal() + 60 * (i % 3 == 0), 0.02 + 0.1 * (i % 2) + 0.004 * rng.normal(), 0.9) for i in range(n)]
    return spark.createDataFrame([(f"s{c}-{i:05d}", *map(float, r)) for c in range(copies) for i, r in enumerate(made)], SCHEMA)


def labels(df):
    return {r["sample_id"]: (r["full_label"], round(r["macro_cluster_prob"], 3)) for r in clusters.nested(df, k=2).collect()}


def test_nested_is_the_same_in_one_task_and_in_many(spark, monkeypatch):
    df = table(spark, 500, copies=2)
    one = labels(df)
    assert len({v[0] for v in one.values()}) > 2
    monkeypatch.setattr(clusters, "ONE_TASK", 0)
    for name, value in (("LAST", 100), ("CELL", 60), ("KEPT", 10), ("TASK", 150), ("BLOCK", 128)):
        monkeypatch.setattr(hierarchy, name, value)
    assert labels(df) == one


def test_nested_takes_more_rows_than_one_model(spark, monkeypatch):
    monkeypatch.setattr(models, "LARGEST", 400)
    monkeypatch.setattr(clusters, "ONE_TASK", 300)
    for name, value in (("LAST", 200), ("CELL", 100), ("KEPT", 10)):
        monkeypatch.setattr(hierarchy, name, value)
    assert len(labels(table(spark, 900))) == 900


def test_merges_in_cells_are_those_of_the_whole_tree(spark, monkeypatch):
    for name, value in (("LAST", 60), ("CELL", 50), ("KEPT", 4), ("TASK", 100)):
        monkeypatch.setattr(hierarchy, name, value)
    rng = np.random.default_rng(1)
    x, w = np.vstack([rng.normal(0, 1, (300, 2)), rng.normal(5, 0.3, (200, 2))]), rng.integers(1, 6, 500).astype(float)
    df = spark.createDataFrame([(i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, w))], "i bigint, a double, b double, w double")
    fine, coarse = hierarchy.cuts(df, ["a", "b"], 8)
    got = np.array([r["fine"] for r in fine.orderBy("i").collect()])
    tree = models.ward(x, w)
    for k in range(2, 9):
        assert models.adjusted_rand(models.cut(tree, k), coarse[k - 2][got]) == 1.0
    assert len(got) == 500


def test_ward_of_weights_is_ward_of_copies():
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(40, 2)), rng.integers(1, 5, 40)
    copies = np.repeat(np.arange(40), w)
    for k in (2, 5, 8):
        assert models.adjusted_rand(models.cut(models.ward(x, w), k)[copies], models.cut(models.ward(x[copies]), k)) == pytest.approx(1.0)


def test_distances_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "BLOCK", 32)
    rng = np.random.default_rng(3)
    x, w, fine = rng.normal(size=(100, 2)), rng.integers(1, 4, 100), rng.integers(0, 3, 100)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(w[i]), int(fine[i])) for i in range(100)], "i bigint, a double, b double, w double, fine int")
    got = np.array([[r["d0"], r["d1"], r["d2"]] for r in hierarchy.distances_to(df, ["a", "b"], 3).orderBy(F.col("i")).collect()])
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    assert np.allclose(got, np.stack([d[:, fine == c] @ w[fine == c] for c in range(3)], 1))

"""Clusters of a reference and of resampled tables, borders, metadata, downstream tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from specflow.functions import convert, models
from specflow.operators import clusters, statistics, transitions
from specflow.plans import pipeline
from specflow.sources import documents


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(90):
        low = i < 40
        rows.append((f"s{i:02d}", float(rng.normal(2.7 if low else 2.4, 0.03)), float(rng.normal(0.05 if low else 0.4, 0.02)), float(rng.normal(60 if low else 90 + 60 * (i % 2), 3)), 0.9, int(not low), "A" if low else f"B.{1 + i % 2}"))
    return spark.createDataFrame(rows, "sample_id string, E_g_eV double, A_sub double, E_u_meV double, A_sub_coverage double, macro_cluster int, full_label string").cache()


def test_classes_come_from_the_reference_alone(spark, table):
    new = table.where("sample_id in ('s01', 's50', 's51')").withColumn("sample_id", F.concat(F.lit("n"), "sample_id"))
    all_ = {r["sample_id"]: r for r in clusters.classify(new, table).collect()}
    assert {k: (r["macro_cluster"], r["full_label"], r["borderline"]) for k, r in all_.items()} == {"ns01": (0, "A", False), "ns50": (1, "B.1", False), "ns51": (1, "B.2", False)}
    far = spark.createDataFrame([("far", 9.0, 9.0, 900.0)], "sample_id string, E_g_eV double, A_sub double, E_u_meV double")
    both = {r["sample_id"]: r for r in clusters.classify(new.select("sample_id", "E_g_eV", "A_sub", "E_u_meV").unionByName(far), table).collect()}
    assert all(both[k]["probability"] == all_[k]["probability"] for k in all_)
    assert all(0.5 <= r["probability"] <= 1 for r in both.values())


def test_boundary_samples_have_tags(spark, table):
    model = clusters.macro_model(table)
    found = clusters.posteriors(table, model)
    p = model.probabilities(np.array([[r["E_g_eV"], r["A_sub"]] for r in table.orderBy("sample_id").collect()]))
    assert [r["posterior_minority"] for r in found.orderBy("sample_id").collect()] == pytest.approx(p.min(1).tolist())
    tags = spark.createDataFrame([("s00", "urea"), ("s00", "urea"), ("s41", None)], "sample_id string, family string")
    top = clusters.boundary_samples(found, tags, ["family"], n=90).collect()
    assert len(top) == 90 and {r["sample_id"]: r["family"] for r in top}["s00"] == "urea" and {r["family"] for r in top} == {"urea", "unknown"}
    assert [r["posterior_minority"] for r in clusters.boundary_samples(found, tags, ["family"], n=5).orderBy(F.desc("posterior_minority")).collect()] == sorted(p.min(1).tolist(), reverse=True)[:5]
    assert clusters.certain(found).where("certain").count() == int((p.max(1) >= 0.7).sum())


def test_representatives(table):
    got = {r["macro_cluster"]: (r["sample_id"], r["distance"]) for r in clusters.representatives(table, "macro_cluster", ["E_g_eV", "A_sub"], "sample_id").collect()}
    rows = table.collect()
    for c in (0, 1):
        x = np.array([[r["E_g_eV"], r["A_sub"]] for r in rows if r["macro_cluster"] == c])
        d = np.sqrt(((x - x.mean(0)) ** 2).sum(1))
        assert got[c] == ([r["sample_id"] for r in rows if r["macro_cluster"] == c][d.argmin()], pytest.approx(d.min()))


def test_noise_is_split(spark):
    rng = np.random.default_rng(1)
    turn = np.arange(14) * 2 * np.pi / 14  # far from both, and from each other
    x = np.concatenate([rng.normal(0, 0.05, (30, 2)), rng.normal(1, 0.05, (30, 2)), 0.5 + 12 * np.stack([np.cos(turn), np.sin(turn)], 1)])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "sample_id int, x double, y double")
    rows = clusters.with_noise_split(df, ["x", "y"], least_size=20).collect()
    noise = [r for r in rows if r["density"] == -1]
    assert len(noise) >= 6 and min(r["combined"] for r in rows) == 0 and min(r["combined"] for r in noise) > max(r["density"] for r in rows)
    assert all(r["combined"] == r["density"] for r in rows if r["density"] >= 0)


def test_nested_bootstrap(table):
    runs = clusters.nested_bootstrap(table, n=6)
    rows, total = clusters.bootstrap_stability(runs)
    t = total.first()
    assert t["n"] == 6 and t["macro_ari_mean"] > 0.99 and t["full_ari_mean"] > 0.9 and t["split"] == 1.0
    # every run names the sub-clusters of B by their mean, which is not how the fixture named them: labels agree among runs
    same = runs.groupBy("sample_id", "full_label").count().groupBy("sample_id").agg((F.max("count") / F.sum("count")).alias("share"))
    assert all(r["n"] <= 6 for r in rows.collect()) and same.agg(F.avg("share")).first()[0] > 0.9 and runs.groupBy("iteration").count().where("count <> 72").count() == 0


def test_alternative_subclusters(table):
    got = clusters.alternative_subclusters(table).groupBy("method").agg(F.max("n_clusters").alias("k"), F.count("*").alias("n"), F.max("silhouette").alias("s")).collect()
    assert {r["method"]: r["n"] for r in got} == {"hierarchical": 50, "gmm": 50, "spectral": 50} and all(r["k"] >= 2 and r["s"] > 0.4 for r in got)


def test_borders_lie_between_classes(spark):
    border = clusters.border_points(lambda p: p[:, 0] > 0, np.array([[-1.0, -1.0], [1.0, 1.0]]), cells=101)
    assert len(border) == 101 and np.abs(border[:, 0]).max() <= 0.031
    rng = np.random.default_rng(2)
    rows = [(float(s + rng.normal(0, 0.2)), float(rng.normal(0, 1)), s) for s in (-1, 1) for _ in range(40)]
    reference = spark.createDataFrame(rows, "x double, y double, side int")
    got = {r["id"]: r for r in clusters.border_distances(spark.createDataFrame([(1, -1.0, 0.0), (2, 1.0, 0.0), (3, 0.02, 0.0)], "id int, x double, y double"), reference).collect()}
    assert got[1]["side"] == -1 and got[2]["side"] == 1 and 0.7 < got[1]["distance"] < 1.3 and got[3]["distance"] < 0.3


def test_permutations_from_margins_agree_with_shuffling(spark):
    rng = np.random.default_rng(3)
    pairs = [(("ab"[int(rng.random() < 0.5)]), "xyz"[rng.integers(3)]) for _ in range(60)]
    rows = [(r, c if rng.random() < 0.6 else ("x" if r == "a" else "y"), float(rng.normal(0.5 * (r == "a"), 1))) for r, c in pairs]
    df = spark.createDataFrame(rows, "r string, c string, v double")

    def chi2(r, c):
        o = np.array([[sum(a == i and b == j for a, b in zip(r, c)) for j in "xyz"] for i in "ab"])
        e = np.outer(o.sum(1), o.sum(0)) / o.sum()
        return ((o - e) ** 2 / e).sum()

    r, c, v = (np.array(x) for x in zip(*rows))
    seen = chi2(r, c)
    shuffled = np.mean([chi2(rng.permutation(r), c) >= seen - 1e-9 for _ in range(1500)])
    assert statistics.permutation_p(df, "r", "c", 1500) == pytest.approx(shuffled, abs=0.05)
    assert statistics.chi2(df, "r", "c").first()["chi2"] == pytest.approx(seen)

    def f(r):
        groups = [v[r == g] for g in "ab"]
        return sum(len(g) * (g.mean() - v.mean()) ** 2 for g in groups) / sum(((g - g.mean()) ** 2).sum() for g in groups)

    plain = np.mean([f(rng.permutation(r)) >= f(r) for _ in range(1500)])
    assert statistics.permutation_f(df, "r", "v", 1500) == pytest.approx(plain, abs=0.05)


def test_group_tests(spark):
    rows = [(f"g{i % 3}", "x" if i % 3 == 0 else "yz"[i % 2], float(i % 3) + (i % 7) / 10, "same") for i in range(90)]
    df = spark.createDataFrame(rows, "g string, t string, v double, one string")
    got = {r["name"]: r for r in statistics.group_tests(df, "g", ["t", "one"], ["v"]).collect()}
    assert set(got) == {"t", "v"} and got["t"]["p"] < 1e-6 and got["v"]["p"] < 1e-6 and 0 < got["v"]["effect"] < 1 and got["t"]["p_adj"] == got["t"]["p"]


def test_quantiles_ranks_and_steps_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=3000), np.full(500, 0.25), [np.nan, 7.0]])
    df = spark.createDataFrame([(float(a), float(i % 9)) for i, a in enumerate(x)] + [(None, None)], "v double, w double")
    from specflow.operators.order import quantiles

    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    assert quantiles(df, ["v", "w"], shares) == {"v": pytest.approx(np.quantile(x[~np.isnan(x)], shares).tolist()), "w": pytest.approx(np.quantile(np.arange(len(x)) % 9, shares).tolist())}
    assert quantiles(df.where("w > 99"), ["v"], [0.5]) == {"v": [None]}
    for n in range(1, 12):
        small = spark.createDataFrame([(float(i * i),) for i in range(n)], "v double")
        assert quantiles(small, ["v"], shares)["v"] == pytest.approx(np.quantile(np.arange(n) ** 2.0, shares).tolist())
    values = x[~np.isnan(x)]
    got = {r["v"]: r["r"] for r in statistics.ranked(df.where("not isnan(v)"), "v", "r").select("v", "r").distinct().collect()}
    order = np.sort(values)
    assert all(got[v] == pytest.approx((np.searchsorted(order, v, "left") + 1 + np.searchsorted(order, v, "right")) / 2) for v in values[::50])


def test_metadata_and_files_to_extract(spark, tmp_path):
    at = tmp_path / "m.csv"
    at.write_text('folder,filename,title,author,is_duplicate,duplicate_of\nx,a.pdf,"A, ""b""",Z,False,\nx,b.pdf,B,,True,x/a.pdf\nReviews,c.pdf,C,,False,\nx,a.pdf,Last,Z,False,\n')
    meta = documents.load_metadata(spark, str(at))
    assert {r["key"]: (r["title"], r["is_duplicate"], r["duplicate_of"]) for r in meta.collect()} == {"x/a.pdf": ("Last", False, None), "x/b.pdf": ("B", True, "x/a.pdf"), "Reviews/c.pdf": ("C", False, None)}
    files = spark.createDataFrame([("p/x/a.pdf", "x", "a.pdf"), ("p/x/b.pdf", "x", "b.pdf"), ("p/Reviews/c.pdf", "Reviews", "c.pdf"), ("p/x/d.pdf", "x", "d.pdf")], "path string, folder string, filename string")
    found = documents.to_extract(documents.with_metadata(files, meta))
    assert sorted(r["filename"] for r in found.collect()) == ["a.pdf", "d.pdf"]
    assert [r["path"] for r in documents.first_files(files, 1).collect()] == ["p/Reviews/c.pdf"] and documents.first_files(files).count() == 4


def test_tag_changes_colours_and_tables(spark, tmp_path):
    trans = spark.createDataFrame([("a", 1, "x", "y"), ("a", 2, "x", "x"), ("b", 3, None, None)], "article string, mod_id int, ref_t string, mod_t string")
    changes = transitions.tag_changes(trans, "article", ["t"], "mod_id")
    assert {r["article"]: (r["ref"], r["mods"], r["changed"]) for r in changes.collect()} == {"a": ("x", "x, y", True), "b": (None, "unknown", False)}
    assert [r[0] for r in spark.createDataFrame([(0,), (3,), (-1,), (None,)], "c int").select(convert.colour(F.col("c"), ["red", "blue"])).collect()] == ["red", "blue", "grey", "grey"]
    pipeline.write_tables({"changes": changes}, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/changes").count() == 2
    assert models.LARGEST > 0

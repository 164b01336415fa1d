"""Files in and out, documents, the stream of curve files, the catalogue of runs, the pipeline driver, numerics against closed forms."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from specflow.functions import convert, fit, models, special
from specflow.operators import clusters, curves
from specflow.plans import catalog, pipeline
from specflow.sources import curves as source
from specflow.sources import documents
from specflow.streaming import ingest

from .test_curves import made


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two folders of curves, one lifted and with a calibrator whose gap is known, and files that hold none."""
    root = tmp_path_factory.mktemp("curves")
    for name, lift in (("lab_001_data", 0.0), ("lab_002_data", 0.03)):
        at = root / name
        at.mkdir()
        for sample, gap in (("s1", 2.7), ("s2", 2.5), *([("c__270", 2.7)] if lift else [])):
            e, a = made(gap)
            (at / f"x_abs_{sample}.csv").write_text("nm;abs\n" + "\n".join(f"{1240 / x};{y + lift}" for x, y in zip(e, a)))
        (at / "results_all.csv").write_text("sample,E_g\ns1,2.7\n")
        (at / "notes.txt").write_text("no curve")
    return root


def test_files_are_found_and_read(spark, folder):
    files = source.read_files(spark, str(folder))
    assert files.count() == 7 and {r["folder"] for r in source.data_folders(files).collect()} == {"lab_001_data", "lab_002_data"}
    kept = source.preferred(files)
    assert {r["stem"] for r in kept.collect()} == {"x_abs_s1", "x_abs_s2", "x_abs_c__270"}
    known = {r["folder"]: r["known_gap"] for r in source.calibrators(kept).collect()}
    assert known == {"lab_002_data": 2.7}
    points = source.with_kind(source.parse_points(kept))
    assert points.count() == 5 * 241 and points.agg(F.max("line_no")).first()[0] == 241 and {r[0] for r in points.select("kind").distinct().collect()} == {"abs"}
    matched = source.match_files(spark.createDataFrame([("lab_002_data", "s1"), ("lab_002_data", "c"), ("lab_002_data", "none")], "folder string, sample string"), kept)
    assert {r["sample"]: r["match_rank"] for r in matched.collect()} == {"s1": 0, "c": 1, "none": None}


def test_kinds_by_values_and_round_trip_of_tauc(spark, tmp_path):
    e, a = made()
    rows = [("p", "f", "plain", i, float(x), float((x * y) ** 0.5)) for i, (x, y) in enumerate(zip(e, a))]
    points = source.with_kind(spark.createDataFrame(rows, "path string, folder string, stem string, line_no int, x double, y double"))
    found = source.spectra(points)
    got = {r["line_no"]: r["absorbance"] for r in found.collect()}
    assert {r["kind"] for r in points.select("kind").distinct().collect()} == {"tauc"} and [got[i] for i in sorted(got)] == pytest.approx(a.tolist(), rel=1e-6, abs=1e-9)
    source.write_tauc(found, str(tmp_path / "t"))
    assert spark.read.option("sep", ";").csv(str(tmp_path / "t")).count() == len(rows)


def test_pipeline_driver_removes_the_offset(spark, folder, tmp_path):
    features = pipeline.feature_table(spark, str(folder))
    rows = {(r["folder"], r["sample"]): r for r in features.collect()}
    assert set(rows) == {(f, s) for f in ("lab_001_data", "lab_002_data") for s in ("s1", "s2")} and all(r["status"] == "ok" for r in rows.values())
    for (_, sample), r in rows.items():
        assert r["E_g_eV"] == pytest.approx(2.7 if sample == "s1" else 2.5, abs=0.03)
    assert rows["lab_002_data", "s1"]["baseline_delta"] == pytest.approx(0.03, abs=0.01)
    source.write_features(features, str(tmp_path))
    back = source.read_features(spark, f"{tmp_path}/results_all")
    assert back.count() == 4 and dict(back.dtypes)["E_g_eV"] == "double"
    with pytest.raises(ValueError, match="columns are missing"):
        source.read_features(spark, f"{tmp_path}/results_all", ("no_such",))


def test_stream_of_files(spark, folder, tmp_path):
    query = ingest.features_to(spark, str(folder / "lab_001_data"), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert query.exception() is None
    rows = spark.read.parquet(str(tmp_path / "out")).where("status = 'ok'").collect()
    assert {r["sample_id"].split("/")[1] for r in rows} >= {"s1", "s2"}
    again = ingest.features_to(spark, str(folder / "lab_001_data"), str(tmp_path / "out"), str(tmp_path / "check"))
    again.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("status = 'ok'").count() == len(rows)


def test_catalogue_of_runs(tmp_path):
    first, second = catalog.create_run(str(tmp_path), "a"), catalog.create_run(str(tmp_path), "b")
    assert catalog.list_runs(str(tmp_path)) == ["a", "b"] and catalog.resolve_run(str(tmp_path)) == second.resolve()
    with pytest.raises(FileNotFoundError):
        catalog.resolve_run(str(tmp_path), "c")
    for run, text in ((first, "x"), (second, "y")):
        (catalog.create_step(run, "one", rows=3) / "t.csv").write_text(text)
    (second / "one" / "more.csv").write_text("z")
    assert [s["rows"] for s in catalog.list_steps(first)] == [3]
    diff = catalog.manifest_diff(catalog.manifest(first), catalog.manifest(second))
    assert diff["one/t.csv"] == "changed" and diff["one/more.csv"] == "added"
    assert catalog.manifest_diff({"x": "1"}, {}) == {"x": "removed"} and catalog.manifest_diff({"x": "1"}, {"x": "1"}) == {}


def test_documents(spark, tmp_path):
    for name in ("a.pdf", "a_SI.pdf", "b.pdf"):
        (tmp_path / "lab").mkdir(exist_ok=True)
        (tmp_path / "lab" / name).write_bytes(b"%PDF " + name.encode())
    files = documents.pdf_files(spark, str(tmp_path), supplements=False)
    assert sorted(r["filename"] for r in files.collect()) == ["a.pdf", "b.pdf"] and documents.pdf_files(spark, str(tmp_path)).count() == 3

    def fails(content: bytes) -> dict:
        raise ValueError("cannot read")

    def reads(content: bytes) -> dict:
        if content.endswith(b"b.pdf"):
            raise ValueError("nor this")
        return {"text": content.decode(), "n_pages": 2, "title": "T"}

    rows = {r["filename"]: r for r in documents.with_text(files, [fails, reads]).collect()}
    assert rows["a.pdf"]["text"] == "%PDF a.pdf" and rows["a.pdf"]["error"] is None and rows["b.pdf"]["error"] == "nor this" and rows["b.pdf"]["text"] is None
    articles = spark.createDataFrame([("x", 3, "high"), ("y", 5, "low")], "id string, word_count int, confidence string")
    documents.write_sections(articles, str(tmp_path / "s"))
    assert sorted(map(tuple, documents.sections(spark, str(tmp_path / "s")).select("id", "word_count", "confidence").collect())) == [("x", 3, "high"), ("y", 5, "low")]
    documents.write_report(articles, str(tmp_path / "r"))
    assert sorted(json.loads(r["value"])["id"] for r in spark.read.text(str(tmp_path / "r")).collect()) == ["x", "y"]


def test_closed_forms_of_the_numerics():
    e = np.linspace(1.0, 4.0, 301)
    edge = fit.linear_edge(e, np.maximum(0, 3.0 * (e - 2.6)))
    assert edge.crossing == pytest.approx(2.6, abs=0.01) and edge.slope == pytest.approx(3.0, abs=0.05) and edge.r2 > 0.999
    a = 0.01 * np.exp((e - 2.6) / 0.08)
    tail = fit.urbach(e, a, 2.6, reach=0.35, window=11)
    assert tail.width_mev == pytest.approx(80, abs=0.5)
    assert special.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05) and special.f_tail(4.964602743730711, 1, 10) == pytest.approx(0.05) and special.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert special.fisher_two_sided(8, 2, 1, 5) == pytest.approx(0.03496503496503495) and special.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert special.kolmogorov_tail(1.3580986393225507) == pytest.approx(0.05, abs=1e-4)


def test_models_on_parted_points():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.1, (30, 2)), rng.normal(3, 0.1, (30, 2))])
    truth = np.repeat([0, 1], 30)
    for labels in (models.mixture(x, 2).predict(x), models.cut(models.ward(x), 2), models.spectral(x, 2)):
        assert models.adjusted_rand(truth, labels) == pytest.approx(1.0)
    assert models.mixture_by_bic(x, 5).means.shape[0] == 2 and models.silhouette(x, truth) > 0.9 and models.davies_bouldin(x, truth) < 0.2
    gain = np.array([[1.0, 9.0, 2.0], [8.0, 7.0, 1.0], [3.0, 2.0, 6.0]])
    assert models.assignment(gain) == [1, 0, 2] and (models.aligned(truth, 1 - truth) == truth).all()
    w, p = models.shapiro(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float))
    assert w == pytest.approx(0.79, abs=0.01) and p < 0.01
    model = models.kernel_classifier(x, 2.0 * truth - 1)
    assert (np.sign(model.decide(x)) == 2 * truth - 1).all()
    width, height, angle = models.ellipse(np.diag([4.0, 1.0]))
    assert (width, height) == (8.0, 4.0) and angle % 180 == pytest.approx(0)
    grid = np.linspace(-1, 1, 2001)
    assert np.trapezoid(models.density(rng.normal(0, 0.1, 200), grid), grid) == pytest.approx(1.0, abs=0.01)


def test_resampling_is_seeded_and_bounded(spark):
    rng = np.random.default_rng(6)
    rows = [(f"s{i:02d}", float(rng.normal(2.7 - 0.3 * (i % 2), 0.02)), float(rng.normal(0.05 + 0.4 * (i % 2), 0.01))) for i in range(40)]
    df = spark.createDataFrame(rows, "sample_id string, E_g_eV double, A_sub double")
    runs = clusters.subsample_bootstrap(df, n=4)
    one, two = (sorted(map(tuple, x.collect())) for x in (runs, clusters.subsample_bootstrap(df.repartition(3), n=4)))
    assert one == two and len(one) == 4 * 32
    stable, its = clusters.stability(runs)
    assert stable.where("stability < 1").count() == 0 and its.agg(F.sum("n")).first()[0] == 4
    pairs = clusters.consensus(runs).collect()
    assert all(0 <= r["together"] <= r["present"] <= 4 for r in pairs) and len(pairs) <= 40 * 39 // 2


def test_perturbed_curves_keep_their_gap(spark):
    e, a = made()
    points = spark.createDataFrame([("one", float(x), float(y)) for x, y in zip(e, a)], "sample_id string, energy double, absorbance double")
    found = curves.features(clusters.perturbed(points, n=3))
    rows = {(r["mode"], r["feature"]): r for r in clusters.perturbation_summary(found).collect()}
    assert {m for m, _ in rows} == {"noise", "dropout", "smooth"} and rows["dropout", "E_g_eV"]["mean"] == pytest.approx(2.7, abs=0.05)


def test_reflectance(spark):
    assert spark.range(1).select(convert.kubelka_munk(F.lit(0.5))).first()[0] == pytest.approx(0.25)

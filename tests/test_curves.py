import numpy as np
import pytest
from pyspark.sql import functions as F

from specflow.functions import fit
from specflow.operators import curves
from specflow.sources import curves as source


def made(gap=2.7, tail=0.06, n=241):
    e = np.linspace(1.3, 3.7, n)
    return e, np.maximum(0.002 * np.exp(np.minimum(0, (e - gap) / tail)), np.where(e > gap, (e - gap) ** 2 / e, 0))


def test_known_gap_and_tail_come_back():
    e, a = made()
    found = curves.analyse(e, a)
    assert abs(found["E_g_eV"] - 2.7) < 0.02 and abs(found["E_u_meV"] - 60) < 2 and found["A_sub"] < 1e-3
    assert (found["E_g_conf"], found["E_u_conf"]) == ("high", "high")


def test_plateau_adds_its_area():
    e, a = made()
    lifted = a + np.where((e > 2.1) & (e < 2.3), 0.02, 0)
    assert curves.analyse(e, lifted)["A_sub_raw"] > curves.analyse(e, a)["A_sub_raw"] + 0.001


def test_prefix_sums_match_polyfit():
    rng = np.random.default_rng(1)
    x, y = np.sort(rng.normal(size=60)), rng.normal(size=60)
    lines = fit.Lines(x, y)
    for i, j in ((0, 60), (3, 17), (40, 44)):
        r2, slope, intercept, _ = lines.fit(i, j)
        s, c = np.polyfit(x[i:j], y[i:j], 1)
        assert np.allclose([slope, intercept], [s, c]) and np.isclose(r2, np.corrcoef(x[i:j], y[i:j])[0, 1] ** 2)
    assert float(fit.Lines(np.arange(9.0), np.ones(9)).fit(0, 9)[0]) == 0.0


def test_smoothing_keeps_parabolas_and_short_input():
    assert np.allclose(fit.savgol(np.arange(30.0) ** 2, 11), np.arange(30.0) ** 2)
    assert fit.savgol(np.arange(3.0)).tolist() == [0, 1, 2]


def test_calibration_finds_the_offset():
    e, a = made()
    delta = fit.baseline_delta(e, a + 0.05, curves.analyse(e, a)["E_g_eV"])
    assert abs(delta - 0.05) < 0.01


def test_parsing(spark):
    text = "nm;abs\n\n420.5;0.831\n2,75;0,912\n1.2e3;4E-1\n400\t0.5\n410 0.4\n2,5 0,3\n7\n"
    files = spark.createDataFrame([("p", "f_data", "x_abs_s1", text)], "path string, folder string, stem string, content string")
    rows = [(r.line_no, r.x, r.y) for r in source.parse_points(files).orderBy("line_no").collect()]
    assert rows == [(2, 420.5, 0.831), (3, 2.75, 0.912), (4, 1200.0, 0.4), (5, 400.0, 0.5), (6, 410.0, 0.4)]


def test_names(spark):
    df = spark.createDataFrame([("a_abs_s__275",), ("a_tauc05_q",), ("plain",)], "stem string")
    got = df.select(source.sample_name(F.col("stem")).alias("s"), source.known_gap(F.col("stem")).alias("g")).collect()
    assert [tuple(r) for r in got] == [("s__275", 2.75), ("q", None), ("plain", None)]


def test_a_failing_curve_fails_alone_and_order_does_not_matter(spark):
    e, a = made()
    rows = [("good", float(x), float(y)) for x, y in zip(e, a)][::-1] + [("short", 1.0, 2.0)]
    points = spark.createDataFrame(rows, "sample_id string, energy double, absorbance double")
    found = {r["sample_id"]: r for r in curves.features(points.repartition(3)).collect()}
    assert found["good"]["status"] == "ok" and found["good"]["E_g_eV"] == pytest.approx(curves.analyse(e, a)["E_g_eV"])
    assert found["short"]["status"] == "failed"


def test_from_files_to_features(spark, tmp_path):
    from specflow.plans.pipeline import feature_table

    e, a = made()
    folder = tmp_path / "lab_001_data"
    folder.mkdir()
    (folder / "x_abs_s1.csv").write_text("nm;abs\n" + "\n".join(f"{1240 / x};{y}" for x, y in zip(e, a)))
    row = feature_table(spark, str(tmp_path)).first()
    assert row["status"] == "ok" and abs(row["E_g_eV"] - 2.7) < 0.02 and row["sample"] == "s1"


def test_runs_far_along_a_long_curve(spark):
    """Lines stay exact where positions and values are large, and where a run goes on into the next cell."""
    rng = np.random.default_rng(5)
    x, y = np.arange(3000.0) + 1e7, np.cumsum(rng.normal(50, 5, 3000)) + 1e6
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double")
    got = {(r["i"], r["j"]): r for r in curves.run_fits(df, "g", "x", "y", narrow=5.0, wide=9.0).collect()}
    assert len(got) == sum(3000 - step for step in range(5, 10))
    for i, j in ((1, 6), (5, 14), (1500, 1507), (2990, 2999), (2995, 3000)):
        u, v = x[i - 1 : j] - x[i - 1], y[i - 1 : j] - y[i - 1]
        slope = np.polyfit(u, v, 1)[0]
        r = got[i, j]
        assert abs(r["slope"] - slope) < 1e-9 and abs(r["r2"] - np.corrcoef(u, v)[0, 1] ** 2) < 1e-9 and r["n"] == j - i + 1

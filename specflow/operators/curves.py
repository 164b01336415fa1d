"""Descriptors of curves. Numerics of one curve run in a grouped function; folders, files and calibration are joins.

A curve is a group of ``sample_id``: one exchange, then every curve is analysed where its points are. What fails in one curve
ends in its ``status`` and ``error`` and nowhere else.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fit
from ..session import checkpointed
from .order import group_quantiles

FEATURES = (
    "sample_id string, E_g_eV double, E_g_R2 double, E_g_conf string, edge_slope double, transition_width double, E_u_meV double, E_u_R2 double, E_u_conf string, "
    "A_sub double, A_sub_raw double, A_sub_coverage double, A_sub_conf string, E_g_region_start double, E_g_region_end double, E_u_region_start double, E_u_region_end double, "
    "A_sub_region_start double, A_sub_region_end double, A_sub_ideal_start double, eu_eg_ratio double, subgap_slope double, edge_asymmetry double, edge_asymmetry_low_pts boolean, "
    "urbach_residual double, baseline_corrected boolean, baseline_delta double, status string, error string"
)
LEAST_POINTS = 20


def analyse(energy: np.ndarray, absorbance: np.ndarray, *, delta: float = 0.0, from_tauc: bool = False, exponent: float = 0.5, reach: float = 0.35, window: int = 11) -> dict:
    """All descriptors of one curve, sorted by energy; raises ValueError where one cannot be had."""
    if len(energy) < LEAST_POINTS:
        raise ValueError(f"{len(energy)} points, {LEAST_POINTS} are needed")
    if delta > 0:
        absorbance = np.maximum(absorbance - delta, 1e-12)
    edge = fit.linear_edge(energy, fit.savgol((absorbance * energy) ** exponent))
    if edge is None:
        raise ValueError("no straight edge")
    gap = edge.crossing
    tail = fit.urbach(energy, fit.savgol(absorbance) if from_tauc else absorbance, gap, reach=reach, window=window)
    if tail is None:
        raise ValueError("no exponential tail")
    excess = fit.sub_gap_excess(energy, absorbance, tail)
    span = (float(energy[edge.start]), float(energy[edge.stop - 1]))
    return {
        "E_g_eV": gap, "E_g_R2": edge.r2, "E_g_conf": edge.confidence, "edge_slope": edge.slope, "transition_width": span[1] - span[0],
        "E_u_meV": tail.width_mev, "E_u_R2": tail.r2, "E_u_conf": tail.confidence, "A_sub": excess.per_ev, "A_sub_raw": excess.area, "A_sub_coverage": excess.coverage, "A_sub_conf": excess.confidence,
        "E_g_region_start": span[0], "E_g_region_end": span[1], "E_u_region_start": tail.start_energy, "E_u_region_end": tail.end_energy,
        "A_sub_region_start": excess.start, "A_sub_region_end": excess.stop, "A_sub_ideal_start": excess.ideal_start, "eu_eg_ratio": tail.width_mev / 1000 / gap if gap > 0 else 0.0,
        **fit.shape_features(energy, absorbance, span, gap, tail, excess), "baseline_corrected": delta > 0, "baseline_delta": delta, "status": "ok", "error": None,
    }


def features(points: DataFrame, **options) -> DataFrame:
    """points: sample_id, energy, absorbance, and optionally delta and from_tauc, constant within a curve."""
    wanted = points.select("sample_id", "energy", "absorbance", (F.col("delta") if "delta" in points.columns else F.lit(0.0)).alias("delta"), (F.col("from_tauc") if "from_tauc" in points.columns else F.lit(False)).alias("from_tauc"))
    kinds = dict(c.split() for c in FEATURES.split(", "))
    arrow = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}

    def one(points: pa.StructArray, delta: float | None, from_tauc: bool | None) -> dict:
        energy, absorbance = (points.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("energy", "absorbance"))
        order = np.lexsort((absorbance, energy))
        try:
            return analyse(energy[order], absorbance[order], delta=float("nan") if delta is None else delta, from_tauc=bool(from_tauc), **options)
        except (ValueError, FloatingPointError, np.linalg.LinAlgError) as e:
            return {"status": "failed", "error": str(e)}

    def run(stream):
        for batch in stream:
            ids, held, delta, from_tauc = batch.columns
            rows = [one(held.slice(i, 1).flatten(), delta[i].as_py(), from_tauc[i].as_py()) | {"sample_id": ids[i].as_py()} for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], arrow[t], from_pandas=True) for n, t in kinds.items()], names=list(kinds))

    # many curves go to Python at once: a call, a frame and a batch for each cost several times what its analysis does
    held = wanted.groupBy("sample_id").agg(F.collect_list(F.struct("energy", "absorbance")).alias("points"), F.first("delta").cast("double").alias("delta"), F.first("from_tauc").alias("from_tauc"))
    return held.mapInArrow(run, FEATURES)


def legacy_gaps(points: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """group, gap, r2, slope, intercept, i, j (places, from 0, both of the line), x_i, x_j, confidence of each curve by the older search; a
    curve on which nothing rises has nulls and says so."""
    names = "gap double, r2 double, slope double, intercept double, i int, j int, x_i double, x_j double, confidence string"

    def one(curve: pd.DataFrame) -> pd.DataFrame:
        curve = curve.sort_values([x, y], kind="stable")
        e = curve[x].to_numpy(float)
        found = fit.legacy_edge(e, curve[y].to_numpy(float))
        row = dict.fromkeys(n.split()[0] for n in names.split(", ")) | {"confidence": "none"}
        if found is not None:
            row = {"gap": found.crossing if found.slope > 0 else 0.0, "r2": found.r2, "slope": found.slope, "intercept": found.intercept, "i": found.start, "j": found.stop - 1, "x_i": e[found.start], "x_j": e[found.stop - 1], "confidence": found.confidence}
        return pd.DataFrame([{group: curve[group].iloc[0], **row}])

    return points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(group, x, y).groupBy(group).applyInPandas(one, f"`{group}` {dict(points.dtypes)[group]}, {names}")


def deltas(points: DataFrame, known: DataFrame, exponent: float = 0.5) -> DataFrame:
    """folder, delta, baseline_known_Eg: one offset for each folder, from its calibrator's points (folder, energy, absorbance)."""

    def one(curve: pd.DataFrame) -> pd.DataFrame:
        curve = curve.sort_values("energy")
        gap = float(curve["known_gap"].iloc[0])
        return pd.DataFrame({"folder": [curve["folder"].iloc[0]], "delta": [fit.baseline_delta(curve["energy"].to_numpy(), curve["absorbance"].to_numpy(), gap, exponent)], "baseline_known_Eg": [gap]})

    joined = points.join(known, "folder").select("folder", "energy", "absorbance", "known_gap")
    return joined.groupBy("folder").applyInPandas(one, "folder string, delta double, baseline_known_Eg double")


def with_deltas(points: DataFrame, found: DataFrame) -> DataFrame:
    """Every curve of a folder gets its calibrator's offset, those without one 0."""
    return points.drop("delta").join(found, "folder", "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))


# Relational forms of the curve operators, on (group, position, x, y); they need no Python.


def sliding_fits(points: DataFrame, group: str, order: list[str], x: str, y: str, size: int) -> DataFrame:
    """Least squares over each full run of ``size`` rows: group, start, r2, slope, intercept."""
    by = Window.partitionBy(group).orderBy(*order)
    run = by.rowsBetween(0, size - 1)
    flat = F.var_pop(y).over(run) == 0
    out = points.select(group, F.row_number().over(by).alias("start"), F.count("*").over(run).alias("_n"), F.when(flat, 0.0).otherwise(F.regr_r2(y, x).over(run)).alias("r2"), F.regr_slope(y, x).over(run).alias("slope"), F.regr_intercept(y, x).over(run).alias("intercept"))
    return out.where(F.col("_n") == size).drop("_n")


def best_window(fits: DataFrame, group: str, least_slope: float = 0.1, digits: int = 9) -> DataFrame:
    """The rising run of highest r2 of each group, the first of equals."""
    rank = F.struct((-F.round("r2", digits)).alias("r"), F.col("start"))
    best = fits.where(F.col("slope") > least_slope).groupBy(group).agg(F.min_by(F.struct("start", "r2", "slope", "intercept"), rank).alias("b"))
    return best.select(group, "b.*")


def trapezoid(points: DataFrame, group: str, order: list[str], x: str, y: str, name: str = "area") -> DataFrame:
    by = Window.partitionBy(group).orderBy(*order)
    step = (F.lead(x).over(by) - F.col(x)) * (F.lead(y).over(by) + F.col(y)) / 2
    return points.select(group, step.alias("_a")).groupBy(group).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias(name))


def minmax(points: DataFrame, group: str, y: str, name: str) -> DataFrame:
    """Each value between its group's least and greatest; as it is where they are equal."""
    ends = points.groupBy(group).agg(F.min(y).alias("_low"), F.max(y).alias("_high"))
    scaled = F.when(F.col("_high") > F.col("_low"), (F.col(y) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(F.col(y))
    return points.join(ends, group).withColumn(name, scaled).drop("_low", "_high")


def baseline(points: DataFrame, group: str, y: str, share: float = 0.1) -> DataFrame:
    """A group's quantile of y: the level that excess is counted from."""
    return group_quantiles(points, [group], y, [share]).select(group, F.get("q", F.lit(0)).alias("baseline"))


def excess_area(points: DataFrame, group: str, order: list[str], x: str, y: str) -> DataFrame:
    """Area of what exceeds the baseline."""
    over = points.join(baseline(points, group, y), group).withColumn("_over", F.greatest(F.lit(0.0), F.col(y) - F.col("baseline")))
    return trapezoid(over, group, order, x, "_over", "excess")


def smoothed(points: DataFrame, group: str, order: list[str], y: str, name: str, window: int = 7, degree: int = 2) -> DataFrame:
    """Savitzky-Golay smoothing as columns: each point a weighted sum of its neighbours, the ends on the polynomial of the end windows.
    A curve shorter than the window stays as it is. Frames are bounded, so a curve of any length goes through without being held."""
    half = window // 2
    basis = np.vander(np.arange(-half, half + 1), degree + 1, increasing=True)
    weights = basis @ np.linalg.pinv(basis)  # a row for each place in a window, of a weight for each of its points
    by = Window.partitionBy(group).orderBy(*order)
    ranked = points.withColumn("_at", F.row_number().over(by)).withColumns({f"_y{k}": (F.lag(y, -k) if k < 0 else F.lead(y, k)).over(by) if k else F.col(y) for k in range(1 - window, window)})
    # places are counted from the ends as neighbours run out: the last point has no follower
    left = F.least(F.col("_at") - 1, F.lit(half))
    right = sum((F.when(F.lead("_at", k).over(by).isNotNull(), 1).otherwise(0) for k in range(1, half + 1)), F.lit(0))
    more = sum((F.when(F.lead("_at", k).over(by).isNotNull(), 1).otherwise(0) for k in range(1, window)), F.lit(0))
    ranked = ranked.withColumn("_left", left).withColumn("_right", right).withColumn("_enough", (F.col("_at") + more >= window))
    place = F.when(F.col("_left") < half, F.col("_left")).otherwise(window - 1 - F.col("_right"))  # of the point in its window
    value = F.col(y)
    for at in range(window):
        value = F.when(F.col("_enough") & (place == at), sum((float(weights[at, j]) * F.col(f"_y{j - at}") for j in range(window)), F.lit(0.0))).otherwise(value)
    return ranked.withColumn(name, value).drop("_at", "_left", "_right", "_enough", *(f"_y{k}" for k in range(1 - window, window)))


#: Runs of points that go back to Spark at once, about.
RUNS = 1 << 18


def run_fits(points: DataFrame, group: str, x: str, y: str, *, narrow: float, wide: float, least: int = 5) -> DataFrame:
    """group, i, j, x_i, x_j, n, slope, intercept, r2, error of the straight line through every run of points (places i to j of a curve, by
    x, then y) that spans ``narrow`` to ``wide`` of x and ``least`` steps or more. x is cut into cells as wide as the band; a cell gets its own
    points, where runs begin, and those of the next, and all runs of many cells grow by a point at a time, with sums of distances from
    where they begin: exact wherever on a long curve a run lies. A curve need not fit a task. x and y are not null."""
    kind = dict(points.dtypes)[group]
    place = F.row_number().over(Window.partitionBy(group).orderBy(x, y))
    p = points.select(F.col(group).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), place.alias("at"))
    cell = F.floor(F.col("x") / wide).cast("bigint")
    copies = F.explode(F.array(F.struct(cell.alias("cell"), F.lit(True).alias("own")), F.struct((cell - 1).alias("cell"), F.lit(False).alias("own")))).alias("c")
    cells = p.select("g", "x", "y", "at", copies).groupBy("g", "c.cell").agg(F.collect_list(F.struct("x", "y", "at", "c.own")).alias("points")).select("g", "points")

    def grown(stream):
        for batch in stream:
            lists = batch.column(1)
            held, record = lists.flatten(), np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            xs, ys, at, own = (held.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "at", "own"))
            order = np.lexsort((at, record))
            xs, ys, at, own, record = (v[order] for v in (xs, ys, at, own, record))
            first, last = np.nonzero(own)[0], np.searchsorted(record, record, side="right")
            sums, made, rows, step = np.zeros((5, len(first))), [], 0, 0
            while len(first):
                step += 1
                goes = first + step < last[first]
                goes[goes] = xs[first[goes] + step] - xs[first[goes]] <= wide
                first, sums = first[goes], sums[:, goes]
                end = first + step
                u, v, n = xs[end] - xs[first], ys[end] - ys[first], step + 1.0
                sums += (u, v, u * u, u * v, v * v)
                if step >= least and (out := u >= narrow).any():
                    i, j, (su, sv, uu, uv, vv) = first[out], end[out], sums[:, out]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        sxx, sxy, syy = uu - su * su / n, uv - su * sv / n, vv - sv * sv / n
                        good = (n >= 3) & (sxx > 1e-18)
                        slope = np.where(good, sxy / sxx, 0.0)
                        r2 = np.where(good & (syy > 1e-18), np.clip(sxy * sxy / (sxx * syy), 0, 1), 0.0)
                        intercept = np.where(good, ys[i] + sv / n - slope * (xs[i] + su / n), 0.0)
                        error = np.where(good & (slope != 0), np.sqrt(np.maximum(0, (1 - r2) * syy / sxx / (n - 2))) / np.abs(slope), 1.0)
                    columns = [at[i], at[j], xs[i], xs[j], np.full(len(i), step + 1), slope, intercept, r2, error]
                    made.append(pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(record[i])), *map(pa.array, columns)], names=["g", "i", "j", "x_i", "x_j", "n", "slope", "intercept", "r2", "error"]))
                    rows += len(i)
                    if rows >= RUNS:
                        yield from made
                        made, rows = [], 0
            yield from made

    found = cells.mapInArrow(grown, f"g {kind}, i int, j int, x_i double, x_j double, n bigint, slope double, intercept double, r2 double, error double")
    return found.withColumnRenamed("g", group)


def tail_of_runs(runs: DataFrame, group: str, *, least_r2: float = 0.97, narrowest: float = 15.0, widest: float = 800.0, near: float = 0.005) -> DataFrame:
    """group, width (mev), r2, x_i, x_j, slope, intercept, runs: of rising runs that are straight enough, those whose score (r2 less 0.15 of the
    relative error) is within ``near`` of the best have a median width; the line is that of the run closest to it, ties by score, then
    the earlier run."""
    width = 1000 / F.col("slope")
    kept = runs.where((F.col("slope") > 0) & (F.col("r2") >= least_r2)).withColumn("width", width).where(F.col("width").between(narrowest, widest)).withColumn("score", F.col("r2") - 0.15 * F.col("error"))
    kept = checkpointed(kept.drop("n", "error"))  # runs are found once, not once for each use
    best = kept.groupBy(F.col(group).alias("_g")).agg(F.max("score").alias("_best"))
    chosen = checkpointed(kept.join(best, F.col(group).eqNullSafe(F.col("_g"))).where(F.col("score") >= F.col("_best") - near).drop("_g", "_best"))
    middle = group_quantiles(chosen, [group], "width", [0.5]).select(F.col(group).alias("_g"), F.col("n").alias("_n"), F.get("q", F.lit(0)).alias("_m"))
    first = F.min_by(F.struct("r2", "x_i", "x_j", "slope", "intercept"), F.struct(F.round(F.abs(F.col("width") - F.col("_m")), 6), F.round(-F.col("score"), 9), "i", "j"))
    out = chosen.join(middle, F.col(group).eqNullSafe(F.col("_g"))).groupBy(group).agg(F.max("_m").alias("width"), F.max("_n").alias("runs"), first.alias("line"))
    return out.select(group, "width", "line.r2", "line.x_i", "line.x_j", "line.slope", "line.intercept", "runs")

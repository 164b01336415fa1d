"""Tests of association and difference, correlations, outliers and scalings, over aggregates.

Statistics are computed in the JVM from contingency counts, moments and ranks; a tail probability is a vectorised function of
the few rows that result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..session import checkpointed
from .order import group_quantiles, least_from, quantiles, ranged, running, same
from .summaries import crosstab


def tail(name: str, *arguments: Column) -> Column:
    """A tail probability of ``special``, null where an argument is. Whole batches are evaluated at a time."""
    function = getattr(special, name)

    @F.pandas_udf("double")
    def of(*columns: pd.Series) -> pd.Series:
        values = np.array([c.to_numpy(np.float64, na_value=np.nan) for c in columns])
        out, known = np.full(values.shape[1], np.nan), ~np.isnan(values).any(0)
        out[known] = function(*values[:, known])
        return pd.Series(out).astype("Float64").where(known, None) if not known.all() else pd.Series(out)

    return of(*arguments)


def chi2(df: DataFrame, row: str, col: str, *, correction: bool = True) -> DataFrame:
    """chi2, dof, n, cramers_v of one contingency table; with one degree of freedom corrected by Yates, V from that too."""
    cells = crosstab(df, row, col).select(F.lit(1).alias("s"), "r", "c", F.col("n").alias("o"))
    out = of_cells(cells, 0, correction)
    least = F.least("kr", "kc") - 1
    return out.select("chi2", "dof", "n", F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * least)).alias("cramers_v"))


def of_cells(cells: DataFrame, least: int, correction: bool = True) -> DataFrame:
    """cells: s, r, c, o, the cells that are not empty of a table for each s. Returns s, chi2, dof, n, kr, kc of tables of ``least`` rows
    or more.

    Empty cells are not needed: the sum of (o - e)^2 / e over all cells is n (sum of o^2 / (nr nc) - 1). In a table of two rows and
    two columns |o - e| is the same in all cells, so Yates' correction needs one of them and the sum of 1 / e, a product of margins.
    """
    rows, cols = cells.groupBy("s", "r").agg(F.sum("o").alias("nr")), cells.groupBy("s", "c").agg(F.sum("o").alias("nc"))
    size = rows.groupBy("s").agg(F.sum("nr").alias("n"), F.count("*").alias("kr"), F.sum(1 / F.col("nr")).alias("ir"))
    size = size.join(cols.groupBy("s").agg(F.count("*").alias("kc"), F.sum(1 / F.col("nc")).alias("ic")), "s").where(F.col("n") >= least)
    o, e = F.col("o"), F.col("nr") * F.col("nc")
    share = cells.join(rows, ["s", "r"]).join(cols, ["s", "c"]).groupBy("s").agg(F.sum(o * o / e).alias("q"), F.max(F.struct(e.alias("e"), o.alias("o"))).alias("one"))
    out = share.join(size, "s")
    n = F.col("n")
    off = F.abs(F.col("one.o") - F.col("one.e") / n)
    off = off - F.least(F.lit(0.5), off)
    corrected = off * off * n * F.col("ir") * F.col("ic")
    small = F.lit(correction) & (F.col("kr") == 2) & (F.col("kc") == 2)
    value = F.when(small, corrected).otherwise(F.greatest(F.lit(0.0), n * (F.col("q") - 1)))
    return out.select("s", value.alias("chi2"), ((F.col("kr") - 1) * (F.col("kc") - 1)).alias("dof"), "n", "kr", "kc")


def with_chi2_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p", tail("chi2_tail", F.col("chi2"), F.col("dof")))


def enrichment(df: DataFrame, cluster: str, tag: str, least_n: int = 3, least_expected: float = 1.0) -> DataFrame:
    """Observed over expected counts of each pair, with the four cells of its 2 x 2 table a, b, c, d."""
    cells = crosstab(df, cluster, tag)
    nr, nc = cells.groupBy("r").agg(F.sum("n").alias("nr")), cells.groupBy("c").agg(F.sum("n").alias("nc"))
    size = cells.agg(F.sum("n").alias("total"))
    full = nr.crossJoin(nc).join(cells, ["r", "c"], "left").crossJoin(F.broadcast(size)).withColumn("a", F.coalesce("n", F.lit(0)))
    expected = F.col("nr") * F.col("nc") / F.col("total")
    out = full.withColumn("expected", expected).where((F.col("nc") >= least_n) & (F.col("expected") >= least_expected))
    return out.select("r", "c", "a", (F.col("nr") - F.col("a")).alias("b"), (F.col("nc") - F.col("a")).alias("c2"), (F.col("total") - F.col("nr") - F.col("nc") + F.col("a")).alias("d"), "expected", (F.col("a") / F.col("expected")).alias("ratio"))


def with_fisher_p(cells: DataFrame) -> DataFrame:
    return cells.withColumn("p", tail("fisher_two_sided", *(F.col(x) for x in ("a", "b", "c2", "d"))))


def notable(cells: DataFrame) -> DataFrame:
    return cells.where("ratio > 1.5 or ratio < 0.5 or p < 0.1")


def adjusted(df: DataFrame, p: str, name: str = "p_adj", by: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg: p m / rank, the least of it and of all higher p, 1 at most. Over all rows or in each group; equal p have
    one rank, that of the last. Over all rows different values of p are ordered range by range (see ``order``)."""
    if by:
        every = Window.partitionBy(*by)
        ranked = df.withColumn("_rank", F.count(p).over(every.orderBy(p))).withColumn("_raw", F.col(p) * F.count(p).over(every) / F.col("_rank"))
        low = F.min("_raw").over(every.orderBy(F.desc(p)))
        return ranked.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), low))).drop("_rank", "_raw")
    df = checkpointed(df)  # it is read twice, and what made it may be dear
    counts = ranged(df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n")), "_p")
    total = counts.agg(F.sum("_n").alias("_m"))
    upto = running(counts.withColumn("_at", F.col("_range")), "_p", ["_n"]).withColumnRenamed("_at", "_range")
    raw = upto.crossJoin(F.broadcast(total)).select("_p", "_range", (F.col("_p") * F.col("_m") / F.col("_n")).alias("_raw"))
    out = df.join(least_from(raw, "_p", "_raw"), F.col(p) == F.col("_p"), "left")
    return out.withColumn(name, F.when(F.col("_raw").isNotNull(), F.least(F.lit(1.0), "_raw"))).drop("_p", "_raw")


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """F of one-way analysis over groups of more than one row, from counts, sums and sums of squares."""
    g = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).where("n > 1")
    t = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = g.crossJoin(F.broadcast(t.select(F.col("mean").alias("_mean")))).agg(F.sum(F.col("n") * (F.col("m") - F.col("_mean")) * (F.col("m") - F.col("_mean"))).alias("between"))
    f = F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k")))
    return t.crossJoin(F.broadcast(between)).where("k > 1").select(f.alias("f"), (F.col("k") - 1).alias("d1"), (F.col("n") - F.col("k")).alias("d2"))


def ranked(df: DataFrame, value: str, name: str) -> DataFrame:
    """Average ranks of values: running sums over different values, ordered range by range (see ``order``), join the rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"), F.count("*").alias("_ties"))
    upto = running(counts, "_v", ["_n"]).select("_v", (F.col("_n") - (F.col("_ties") - 1) / 2).alias(name), F.col("_ties").alias(name + "_ties"))
    return df.join(upto, F.col(value) == F.col("_v")).drop("_v")


def mann_whitney(df: DataFrame, group: str, a: str, b: str, value: str) -> DataFrame:
    """u, n1, n2, z (normal, corrected for ties and continuity) of group a against b."""
    r = ranked(df.where(F.col(group).isin(a, b)), value, "_r")
    s = r.agg(F.count_if(F.col(group) == a).alias("n1"), F.count_if(F.col(group) == b).alias("n2"), F.sum(F.when(F.col(group) == a, F.col("_r"))).alias("r1"), F.sum(F.col("_r_ties") * F.col("_r_ties") - 1).cast("double").alias("ties"))
    n = F.col("n1") + F.col("n2")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    spread = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return s.select(u.alias("u"), "n1", "n2", F.try_divide(F.greatest(F.lit(0.0), F.abs(u - F.col("n1") * F.col("n2") / 2.0) - 0.5), spread).alias("z"))


def kolmogorov(df: DataFrame, group: str, a: str, b: str, value: str) -> DataFrame:
    """Greatest distance of the two distribution functions, and the group sizes."""
    counts = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).groupBy(value).agg(F.count_if(F.col(group) == a).alias("ca"), F.count_if(F.col(group) == b).alias("cb"))
    size = counts.agg(F.sum("ca").alias("n1"), F.sum("cb").alias("n2"))
    steps = running(counts, value, ["ca", "cb"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")).crossJoin(F.broadcast(size))
    return steps.groupBy("n1", "n2").agg(F.max(F.abs(F.col("a") / F.col("n1") - F.col("b") / F.col("n2"))).alias("d"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson's r of all pairs, in one pass; rows with both values count."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)), *(F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"n{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    return ranked(ranked(both, a, "_ra"), b, "_rb").agg(F.corr("_ra", "_rb").alias("rho"), F.count("*").alias("n"))


def robust_outliers(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """z = (v - median) / (0.7413 IQR); flagged from 1.5 IQR around the median, extreme beyond 3 IQR outside the quartiles."""
    shares = [0.25, 0.5, 0.75]
    if by:
        keys = [f"_by{i}" for i in range(len(by))]
        stats = group_quantiles(df, by, column, shares).select(F.col("q").alias("_q"), *(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)))
        out = df.join(stats, same(by, keys), "left").drop(*keys)
    else:
        out = df.withColumn("_q", F.array(*map(F.lit, quantiles(df, [column], shares)[column])))
    q1, m, q3 = (F.get("_q", F.lit(i)) for i in range(3))
    iqr, v = q3 - q1, F.col(column)
    out = out.withColumn("z", F.try_divide(v - m, 0.7413 * iqr)).withColumn("outlier", F.abs(v - m) >= 1.5 * iqr)
    return out.withColumn("extreme", (v < q1 - 3 * iqr) | (v > q3 + 3 * iqr)).drop("_q")


def winsorised(df: DataFrame, columns: list[str], method: str = "iqr") -> DataFrame:
    """Values beyond 1.5 IQR outside the quartiles, or beyond the 1st and 99th percentile, are set to those limits."""
    ends = quantiles(df, columns, [0.25, 0.75] if method == "iqr" else [0.01, 0.99])
    margin = {c: 1.5 * (b - a) if method == "iqr" else 0.0 for c, (a, b) in ends.items() if a is not None}
    return df.withColumns({c: F.least(F.greatest(F.col(c), F.lit(ends[c][0] - margin[c])), F.lit(ends[c][1] + margin[c])) for c in columns if c in margin})


def logged(df: DataFrame, columns: list[str]) -> DataFrame:
    """ln(x), or ln(1 + x - min) where a column has values of 0 or less."""
    low = df.agg(*(F.min(c).alias("_" + c) for c in columns))
    out = df.crossJoin(F.broadcast(low))
    return out.withColumns({c: F.when(F.col("_" + c) <= 0, F.log1p(F.col(c) - F.col("_" + c))).otherwise(F.log(F.greatest(F.col(c), F.col("_" + c)))) for c in columns}).drop(*("_" + c for c in columns))


def scaled(df: DataFrame, columns: list[str], method: str = "standard") -> DataFrame:
    """standard (population deviation), minmax, or robust (median and IQR); a constant column becomes 0."""
    if method == "standard":
        ends = [F.struct(F.avg(c).alias("a"), F.stddev_pop(c).alias("b")).alias("_" + c) for c in columns]
    elif method == "minmax":
        ends = [F.struct(F.min(c).alias("a"), (F.max(c) - F.min(c)).alias("b")).alias("_" + c) for c in columns]
    elif method == "robust":
        ends = [F.struct(F.first(F.lit(m)).alias("a"), F.first(F.lit(None if m is None else b - a)).alias("b")).alias("_" + c) for c, (a, m, b) in quantiles(df, columns, [0.25, 0.5, 0.75]).items()]
    else:
        raise ValueError(f"no such scaling: {method}")
    out = df.crossJoin(F.broadcast(df.agg(*ends)))
    return out.withColumns({c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_{c}.a"), F.col(f"_{c}.b")), F.lit(0.0)) for c in columns}).drop(*("_" + c for c in columns))


def recommended_scaler(df: DataFrame, columns: list[str]) -> str:
    """power for a mean absolute skewness above 1, robust if a value is beyond 3 IQR, standard for ranges a hundredfold apart,
    else robust."""
    quartiles = quantiles(df, columns, [0.25, 0.75])
    a = df.agg(*(F.skewness(c).alias(f"s_{c}") for c in columns), *(F.min(c).alias(f"a_{c}") for c in columns), *(F.max(c).alias(f"b_{c}") for c in columns)).first()
    if sum(abs(a[f"s_{c}"] or 0) for c in columns) / len(columns) > 1:
        return "power"
    for c in columns:
        q1, q3 = quartiles[c]
        if a[f"a_{c}"] < q1 - 3 * (q3 - q1) or a[f"b_{c}"] > q3 + 3 * (q3 - q1):
            return "robust"
    spans = [a[f"b_{c}"] - a[f"a_{c}"] for c in columns]
    return "standard" if min(spans) > 0 and max(spans) / min(spans) > 100 else "robust"


def yeo_johnson(x: Column, power: float) -> Column:
    up = F.log1p(x) if abs(power) < 1e-9 else (F.pow(x + 1, F.lit(power)) - 1) / power
    down = -F.log1p(-x) if abs(power - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - power)) - 1) / (2 - power)
    return F.when(x >= 0, up).otherwise(down)


def power_transformed(df: DataFrame, columns: list[str], steps: int = 60) -> tuple[DataFrame, dict[str, float]]:
    """Yeo-Johnson by maximum likelihood, then standardised. Each round evaluates a grid of powers in one pass over the data
    and narrows it; only moments reach the driver."""
    found = {}
    for c in columns:
        low, high, x = -3.0, 5.0, F.col(c)
        for _ in range(4):
            grid = [low + (high - low) * i / 16 for i in range(17)]
            spread = df.agg(F.count(c).alias("n"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("j"), *(F.var_pop(yeo_johnson(x, g)).alias(f"v{i}") for i, g in enumerate(grid))).first()
            import math

            score = [-(spread["n"] / 2) * math.log(v) + (g - 1) * spread["j"] if (v := spread[f"v{i}"]) and v > 0 else -math.inf for i, g in enumerate(grid)]
            k = max(range(17), key=score.__getitem__)
            low, high = grid[max(0, k - 1)], grid[min(16, k + 1)]
        found[c] = grid[k]
    moved = df.withColumns({c: yeo_johnson(F.col(c), p) for c, p in found.items()})
    return scaled(moved, columns), found


def silhouette(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Mean Euclidean silhouette. It is quadratic in the rows by definition: for tables of clustered features."""
    a = df.select(F.col(key).alias("i"), F.col(vector).alias("v"), F.col(label).alias("g"))
    b = df.select(F.col(key).alias("j"), F.col(vector).alias("w"), F.col(label).alias("h"))
    d = F.sqrt(F.aggregate(F.zip_with("v", "w", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))
    near = a.crossJoin(b).groupBy("i", "g", "h").agg(F.sum(d).alias("s"), F.count("*").alias("n"))
    own = F.when(F.col("g") == F.col("h"), F.try_divide(F.col("s"), F.col("n") - 1))
    by = near.groupBy("i", "g").agg(F.max(own).alias("own"), F.min(F.when(F.col("g") != F.col("h"), F.col("s") / F.col("n"))).alias("other"))
    return by.agg(F.avg(F.when(F.col("own").isNull(), 0.0).otherwise(F.try_divide(F.col("other") - F.col("own"), F.greatest("own", "other")))).alias("silhouette"))


#: Clusters times dimensions whose sums go to every task.
LARGEST_SUMS = 1_000_000


def cluster_sums(df: DataFrame, vector: str, label: str, width: int) -> list:
    """label, n, s (the sum of its vectors), q (the sum of their squares) of each cluster, by label: from one pass; bounded."""
    x = [F.get(vector, F.lit(i)).cast("double") for i in range(width)]
    sums = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.array(*(F.sum(v) for v in x)).alias("s"), sum((F.sum(v * v) for v in x), F.lit(0.0)).alias("q"))
    found = sums.orderBy("label").limit(1 + LARGEST_SUMS // width).collect()
    if len(found) * width > LARGEST_SUMS:
        raise ValueError(f"more than {LARGEST_SUMS // width} clusters are too many")
    return found


def squared_silhouette(df: DataFrame, vector: str, label: str, width: int) -> DataFrame:
    """Mean silhouette by squared distances, in time linear in the rows: the mean squared distance of x to a cluster is
    |x|^2 - 2 x s / n + q / n. A cluster of one row counts 0."""
    sums = cluster_sums(df, vector, label, width)
    held = F.array(*(F.struct(F.lit(r["label"]).alias("label"), F.lit(float(r["n"])).alias("n"), F.array(*map(F.lit, r["s"])).alias("s"), F.lit(r["q"]).alias("q")) for r in sums)) if sums else None
    rows = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(label).alias("g"), F.transform(vector, lambda v: v.cast("double")).alias("x"))
    if held is None:
        return rows.agg(F.avg(F.lit(None).cast("double")).alias("silhouette"))
    clusters = df.sparkSession.range(1).select(held.alias("clusters"))
    rows = rows.crossJoin(F.broadcast(clusters))  # one row
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda v, w: v * w), F.lit(0.0), lambda t, v: t + v)
    rows = rows.withColumn("xx", dot("x", "x"))
    far = F.transform("clusters", lambda c: F.struct(c["label"].alias("label"), c["n"].alias("n"), F.greatest(F.lit(0.0), c["n"] * F.col("xx") - 2 * dot(F.col("x"), c["s"]) + c["q"]).alias("t")))
    rows = rows.withColumn("far", far)
    own = F.get(F.filter("far", lambda c: c["label"] == F.col("g")), F.lit(0))
    other = F.array_min(F.transform(F.filter("far", lambda c: c["label"] != F.col("g")), lambda c: c["t"] / c["n"]))
    rows = rows.select(own.alias("own"), other.alias("other")).select(F.col("own.n").alias("n"), F.try_divide(F.col("own.t"), F.col("own.n") - 1).alias("own"), "other")
    value = F.when(F.col("n") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("other") - F.col("own"), F.greatest("own", "other")), F.when(F.col("other").isNotNull(), 0.0)))
    return rows.agg(F.avg(value).alias("silhouette"))


def davies_bouldin(df: DataFrame, vector: str, label: str, width: int) -> DataFrame:
    """The mean over clusters of the greatest (d_i + d_j) / distance of their centres, d the mean distance of a cluster's rows to its
    centre. Two passes; centres, of bounded number, go to every task."""
    sums = cluster_sums(df, vector, label, width)
    spark = df.sparkSession
    if len(sums) < 2:
        return spark.range(1).select(F.lit(None).cast("double").alias("davies_bouldin"))
    centres = spark.createDataFrame([(r["label"], [v / r["n"] for v in r["s"]]) for r in sums], f"h {dict(df.dtypes)[label]}, c array<double>")
    rows = df.where(F.col(vector).isNotNull()).select(F.col(label).alias("h"), F.col(vector).alias("x")).join(F.broadcast(centres), "h")
    gap = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda v, w: (v.cast("double") - w) * (v.cast("double") - w)), F.lit(0.0), lambda t, v: t + v))
    near = {r["h"]: r["d"] for r in rows.groupBy("h").agg(F.avg(gap("x", "c")).alias("d")).collect()}
    m, d = np.array([r["s"] for r in sums]) / np.array([r["n"] for r in sums])[:, None], np.array([near[r["label"]] for r in sums])
    worst = []
    for i in range(len(m)):  # a row of the clusters' distances at a time
        apart = np.sqrt(((m - m[i]) ** 2).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = (d + d[i]) / apart
        ratio[i] = -np.inf
        worst.append(ratio.max())
    return spark.range(1).select(F.lit(float(np.mean(worst))).alias("davies_bouldin"))


def dispersion(df: DataFrame, vector: str, label: str, width: int) -> DataFrame:
    """Calinski-Harabasz index, from one sum for each cluster and dimension."""
    long = df.select(F.col(label).alias("g"), F.posexplode(vector).alias("d", "v"))
    by = long.groupBy("g", "d").agg(F.count("*").alias("n"), F.avg(F.col("v").cast("double")).alias("m"), F.var_pop(F.col("v").cast("double")).alias("var"))
    total = by.groupBy("d").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    parts = by.join(F.broadcast(total), "d").agg(F.sum(F.col("n") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))).alias("b"), F.sum(F.col("n") * F.col("var")).alias("w"), F.count_distinct("g").alias("k"), (F.sum("n") / F.count_distinct("d")).alias("n"))
    return parts.select((F.try_divide(F.col("b") * (F.col("n") - F.col("k")), F.col("w") * (F.col("k") - 1))).alias("calinski_harabasz"))


def rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings, from their contingency table."""
    two = lambda n: n * (n - 1) / 2.0
    cells = crosstab(df, a, b)
    both = cells.agg(F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("n"))
    rows = cells.groupBy("r").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sr"))
    cols = cells.groupBy("c").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sc"))
    one = both.crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(cols))
    chance = F.try_divide(F.col("sr") * F.col("sc"), two(F.col("n")))
    return one.select(F.coalesce(F.try_divide(F.col("s") - chance, (F.col("sr") + F.col("sc")) / 2 - chance), F.lit(1.0)).alias("ari"))


#: Queries of a block, and rows of a block at most, that a task compares with each other.
QUERY_BLOCK, ROW_BLOCK = 4096, 32_768
#: Products that are held at once, exact distances too, and rows of a block that bound a query's k-th distance.
TILE, STEP, LOOK = 1 << 21, 1 << 17, 4096


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """The k nearest rows of each query, (query, key, distance, rank): a stated set of queries against all rows, ties by the smaller key;
    distances that are not numbers come after all others, those to or from a null vector last. Vectors have one length and no nulls inside.

    Blocks of queries meet blocks of rows, both of bounded size. Within a pair, products of matrices tell distances up to rounding; what may be
    among the k nearest by them, with a slack for that, gets its exact distance, coordinate by coordinate. A tile of a pair of blocks returns
    k + 1 rows a query at most. Work is queries times rows, as the exact answer has it."""
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[key]
    asked = checkpointed(queries.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("x")))
    alike = F.row_number().over(Window.partitionBy("x").orderBy("k"))  # of equal vectors the first k + 1 keys are all that can be an answer
    held = checkpointed(rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("x")).withColumn("r", alike).where(F.col("r") <= k + 1).drop("r"))
    n = held.count()
    parts = max(-(-n // ROW_BLOCK), min(-(-n // 1024), 4 * spark.sparkContext.defaultParallelism), 1)
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    block = lambda df, blocks, by, name: df.groupBy(F.pmod(F.xxhash64("k"), F.lit(blocks)).alias(by)).agg(F.collect_list(F.struct("k", "x")).alias(name))
    of_queries = block(asked, query_blocks, "q", "asked").select("asked", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("b"))
    pairs = block(held, parts, "b", "held").repartition(parts, "b").join(of_queries.repartition(parts, "b"), "b").select("asked", "held")

    def matrix(side: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        """The vectors that are there, and their places."""
        x = side.field("x")
        there = np.nonzero(x.is_valid().to_numpy(zero_copy_only=False))[0]
        return x.take(pa.array(there)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(there), -1), there

    def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a))
        with np.errstate(invalid="ignore", over="ignore"):
            for c in range(a.shape[1]):
                out += (a[:, c] - b[:, c]) ** 2
        return np.sqrt(out)

    def first_of(left: np.ndarray, right: np.ndarray, far: np.ndarray, rank: np.ndarray, most: int) -> np.ndarray:
        """Places of the first ``most`` of each of ``left``, by distance, then by the rank of the key; NaN is last."""
        order = np.lexsort((rank[right], far, left))
        return order[np.arange(len(order)) - np.searchsorted(left[order], left[order]) < most]

    def found_in(of: pa.StructArray, others: pa.StructArray) -> pa.RecordBatch:
        (x, at), (y, to) = matrix(of), matrix(others)
        keys, other_keys = of.field("k").to_pylist(), others.field("k").to_pylist()
        rank = np.empty(len(other_keys), int)
        rank[sorted(range(len(other_keys)), key=other_keys.__getitem__)] = np.arange(len(rank))
        nothing = np.zeros(0, int)
        got = [(nothing, nothing, np.zeros(0))]
        with np.errstate(invalid="ignore", over="ignore"):
            if len(x) and len(y):
                eps = 64 * (x.shape[1] + 8) * np.finfo(float).eps
                xx, yy = (x * x).sum(1), (y * y).sum(1)
                fit, odd = np.nonzero(yy < 1e300)[0], np.nonzero(~(yy < 1e300))[0]
                yt, y2 = np.ascontiguousarray(y[fit].T), yy[fit]
                for a in range(0, len(x), step := max(1, TILE // len(y))):
                    place = np.arange(a, min(a + step, len(x)))
                    usual, unusual = place[xx[place] < 1e300], place[~(xx[place] < 1e300)]
                    some = [(np.repeat(p, len(r)), np.tile(r, len(p))) for p, r in ((usual, odd), (unusual, np.arange(len(y))))]
                    if len(usual) and len(fit):
                        d = y2 - 2 * (x[usual] @ yt)
                        part = d[:, : max(LOOK, k + 1)]  # k others, if one is the query itself, bound the k-th
                        bound = np.partition(part, k, axis=1)[:, k] if part.shape[1] > k else np.full(len(usual), np.inf)
                        i, j = np.nonzero(d <= (bound + 2 * eps * (y2.max() + xx[usual]))[:, None])
                        some.append((usual[i], fit[j]))
                    left, right = (np.concatenate(v) for v in zip(*some))
                    far = np.concatenate([exact(x[left[b : b + STEP]], y[right[b : b + STEP]]) for b in range(0, len(left), STEP)] or [np.zeros(0)])
                    left, right = at[left], to[right]
                    kept = first_of(left, right, far, rank, k + 1)
                    got.append((left[kept], right[kept], far[kept]))
        left, right, far = (np.concatenate(v) for v in zip(*got))
        no_x, no_y = np.setdiff1d(np.arange(len(of)), at), np.setdiff1d(np.arange(len(others)), to)
        nulls = [(np.repeat(p, len(r)), np.tile(r, len(p))) for p, r in ((at, no_y[np.argsort(rank[no_y])][: k + 1]), (no_x, np.argsort(rank)[: k + 1]))]
        left, right = np.concatenate([left, *(v[0] for v in nulls)]).astype(int), np.concatenate([right, *(v[1] for v in nulls)]).astype(int)
        null = np.arange(len(left)) >= len(far)
        far = np.concatenate([far, np.zeros(len(left) - len(far))])
        other = np.array([keys[i] != other_keys[j] for i, j in zip(left.tolist(), right.tolist())], bool)
        left, right, null, far = left[other], right[other], null[other], far[other]
        return pa.RecordBatch.from_arrays([of.field("k").take(pa.array(left)), others.field("k").take(pa.array(right)), pa.array(far, mask=null)], names=["query", "other", "distance"])

    def searched(stream):
        for batch in stream:
            for i in range(batch.num_rows):
                yield found_in(*(batch.column(c).slice(i, 1).flatten() for c in (0, 1)))

    found = pairs.mapInArrow(searched, f"query {dict(queries.dtypes)[key]}, other {kind}, distance double").withColumnRenamed("other", key)
    ranked_ = F.row_number().over(Window.partitionBy("query").orderBy(F.asc_nulls_last("distance"), key))
    return found.withColumn("rank", ranked_).where(F.col("rank") <= k)


def stratified(df: DataFrame, stratum: str, row: str, col: str, least: int = 10) -> DataFrame:
    """chi2, dof and n of a contingency table in each stratum of enough rows: the stratum is one more key."""
    d = df.where(F.col(stratum).isNotNull() & F.col(row).isNotNull() & F.col(col).isNotNull()).select(F.col(stratum).alias("s"), F.col(row).alias("r"), F.col(col).alias("c"))
    return of_cells(d.groupBy("s", "r", "c").agg(F.count("*").alias("o")), least).select(F.col("s").alias(stratum), "chi2", "dof", "n")


#: Cells of a table that permutations are drawn for at most: it is held by each task.
LARGEST_TABLE = 1_000_000


def permutation_p(df: DataFrame, row: str, col: str, times: int = 10_000, seed: int = 42) -> float:
    """(1 + permutations with a chi2 at least as high) / (times + 1). Under a permutation of labels a table depends on its margins
    only, so tables are drawn from those, row by row, by numbers that hang on the permutation alone; rows are counted once."""
    cells = crosstab(df, row, col)
    nr = [int(r["n"]) for r in cells.groupBy("r").agg(F.sum("n").alias("n")).orderBy("r").collect()]
    nc = [int(r["n"]) for r in cells.groupBy("c").agg(F.sum("n").alias("n")).orderBy("c").collect()]
    if len(nr) * len(nc) > LARGEST_TABLE:
        raise ValueError(f"{len(nr)} x {len(nc)} levels are too many for a permutation test")
    if len(nr) < 2 or len(nc) < 2:
        return 1.0
    observed = chi2(df, row, col).first()["chi2"]
    expected = np.outer(nr, nc) / sum(nr)
    small = len(nr) == len(nc) == 2

    def at_least(stream):
        for batch in stream:
            hits = 0
            for t in batch["id"]:
                rng, left, table = np.random.default_rng([seed, int(t)]), np.array(nc), []
                for n in nr[:-1]:
                    table.append(rng.multivariate_hypergeometric(left, n, method="marginals"))
                    left = left - table[-1]
                off = np.abs(np.array([*table, left]) - expected)
                off = off - np.minimum(0.5, off) if small else off
                hits += (off * off / expected).sum() >= observed - 1e-9
            yield pd.DataFrame({"hits": [hits]})

    hits = df.sparkSession.range(times).mapInPandas(at_least, "hits bigint").agg(F.sum("hits")).first()[0] or 0
    return (1 + hits) / (times + 1)


#: Values that a task permutes at once.
CHUNK = 10_000


def permutation_f(df: DataFrame, group: str, value: str, times: int = 10_000, seed: int = 42, chunk: int = CHUNK) -> float:
    """(1 + permutations with an F at least as high) / (times + 1), groups of more than one row. A permutation deals the values to
    groups of the same sizes; F rises with the sum of squared group sums over their sizes.

    No task holds all values. They lie in chunks; how many of a chunk's values a permutation deals to each group follows from sizes
    alone, and is drawn from them chunk by chunk; a chunk then deals its own values at random, and sums of groups are added up. So each
    permutation is as likely as any other."""
    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("v"))
    known = rows.groupBy("g").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).where("n > 1").orderBy("g").limit(LARGEST_TABLE + 1).collect()
    if len(known) < 2:
        return 1.0
    sizes, total = np.array([r["n"] for r in known], np.int64), sum(r["s"] for r in known)
    chunks = -(-int(sizes.sum()) // chunk)
    if len(sizes) * chunks > LARGEST_TABLE:
        raise ValueError(f"{len(sizes)} groups of {sizes.sum()} rows are too many for a permutation test")
    mean = total / sizes.sum()  # values are centred: only differences count
    between = lambda s: (s * s / sizes).sum(-1)
    observed = between(np.array([r["s"] for r in known]) - sizes * mean)
    names = df.sparkSession.createDataFrame([(r["g"],) for r in known], "g string")
    held = rows.join(F.broadcast(names), "g", "left_semi").select((F.col("v") - mean).alias("v")).withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("int"))
    held = checkpointed(held)
    filled = {r["chunk"]: r["n"] for r in held.groupBy("chunk").agg(F.count("*").alias("n")).collect()}
    lengths = np.array([filled.get(c, 0) for c in range(chunks)])

    def drawn(stream):
        """For each permutation and chunk, how many of the chunk's values go to each group."""
        for batch in stream:
            for t in batch["id"]:
                rng, left, out = np.random.default_rng([seed, int(t)]), sizes.copy(), []
                for n in lengths:
                    out.append(rng.multivariate_hypergeometric(left, n, method="marginals"))
                    left = left - out[-1]
                yield pd.DataFrame({"t": int(t), "chunk": np.arange(chunks, dtype="int32"), "k": [x.tolist() for x in out]})

    def dealt(key, values: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        v, rng, out = np.sort(values["v"].to_numpy()), np.random.default_rng([seed, times, int(key[0])]), []
        for k in counts.sort_values("t")["k"]:
            run = np.append(0.0, np.cumsum(rng.permutation(v)))
            out.append(np.diff(run[np.append(0, np.cumsum(k))]).tolist())
        return pd.DataFrame({"t": np.sort(counts["t"].to_numpy()), "s": out})

    spark = df.sparkSession
    counts = spark.range(times).mapInPandas(drawn, "t bigint, chunk int, k array<bigint>")
    sums = held.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInPandas(dealt, "t bigint, s array<double>")
    each = sums.groupBy("t").agg(F.array(*(F.sum(F.get("s", F.lit(i))) for i in range(len(sizes)))).alias("s"))
    score = sum((F.get("s", F.lit(i)) * F.get("s", F.lit(i)) / int(n) for i, n in enumerate(sizes)), F.lit(0.0))
    hits = each.where(score >= float(observed) * (1 - 1e-9)).count()
    return (1 + hits) / (times + 1)


def group_tests(df: DataFrame, group: str, tags: list[str], features: list[str], least: int = 2) -> DataFrame:
    """Every tag against the group by chi2 (with V), every feature by one-way F (with eta squared), one row each: kind, name, statistic,
    d1, d2, n, effect, p, and p_adj, Benjamini-Hochberg within its kind. A test with fewer than ``least`` levels or groups is left out."""
    out = []
    for t in tags:
        r = chi2(df, group, t).where(F.col("dof") >= least - 1)
        out.append(r.select(F.lit("chi2").alias("kind"), F.lit(t).alias("name"), F.col("chi2").alias("statistic"), F.col("dof").cast("bigint").alias("d1"), F.lit(None).cast("bigint").alias("d2"), F.col("n").cast("bigint").alias("n"), F.col("cramers_v").alias("effect"), tail("chi2_tail", F.col("chi2"), F.col("dof")).alias("p")))
    for c in features:
        r = anova(df, group, c).where(F.col("d1") >= least - 1)
        eta = F.try_divide(F.col("f") * F.col("d1"), F.col("f") * F.col("d1") + F.col("d2"))
        out.append(r.select(F.lit("anova").alias("kind"), F.lit(c).alias("name"), F.col("f").alias("statistic"), F.col("d1").cast("bigint").alias("d1"), F.col("d2").cast("bigint").alias("d2"), (F.col("d1") + F.col("d2") + 1).cast("bigint").alias("n"), eta.alias("effect"), tail("f_tail", F.col("f"), F.col("d1"), F.col("d2")).alias("p")))
    if not out:
        raise ValueError("no tag and no feature to test")
    tests = out[0]
    for x in out[1:]:
        tests = tests.unionByName(x)
    return adjusted(tests, "p", by=["kind"])


def mixture_shares(df: DataFrame, group: str, parts: dict[str, Column]) -> DataFrame:
    """Share of each group's rows for which a condition holds."""
    return df.groupBy(group).agg(F.count("*").alias("n"), *(F.avg(c.cast("double")).alias(name) for name, c in parts.items()))

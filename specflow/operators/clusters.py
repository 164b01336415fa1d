"""Clustering of a feature table, resampling of it, and classification against it.

A model sees the whole table, which has one row for a curve; it runs as one group of a grouped function. Resampling has a group
for each iteration, so iterations run in parallel and their seeds do not depend on how rows are partitioned.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fit, models
from ..session import checkpointed

#: Features of macro clusters, of sub-clusters, and the one that orders macro clusters.
MACRO, SUB, ORDER = ["E_g_eV", "A_sub"], ["E_u_meV", "A_sub"], "A_sub"
#: Rows whose nested clusters one task finds, with their distances in memory.
ONE_TASK = 4000


def prepared(features: DataFrame, columns: list[str], coverage: float = 0.5) -> DataFrame:
    """Rows of enough coverage with all features."""
    out = features.where(F.col("A_sub_coverage") >= coverage) if "A_sub_coverage" in features.columns else features
    return out.dropna(subset=columns)


def moved(v: np.ndarray, p: float) -> np.ndarray:
    """Yeo-Johnson with power p."""
    up = np.log1p(np.maximum(v, 0)) if abs(p) < 1e-9 else ((np.maximum(v, 0) + 1) ** p - 1) / p
    q = 2 - p
    down = -np.log1p(np.maximum(-v, 0)) if abs(q) < 1e-9 else -((np.maximum(-v, 0) + 1) ** q - 1) / q
    return np.where(v >= 0, up, down)


@dataclass
class Scaling:
    """Yeo-Johnson and standardisation as one table determined them, for any rows."""

    powers: list[float]
    means: np.ndarray
    spreads: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.stack([moved(x[:, j].astype(float), p) for j, p in enumerate(self.powers)], 1) if len(self.powers) else x
        return (z - self.means) / self.spreads


def scaling(x: np.ndarray) -> Scaling:
    """Powers by golden section on their likelihood."""
    powers, columns = [], []
    for j in range(x.shape[1]):
        v = x[:, j].astype(float)
        weight = float((np.sign(v) * np.log1p(np.abs(v))).sum())
        loss = lambda p, v=v, weight=weight: len(v) / 2 * math.log(max(1e-300, moved(v, p).var())) - (p - 1) * weight
        a, b, g = -3.0, 5.0, (math.sqrt(5) - 1) / 2
        while b - a > 1e-5:
            c, d = b - g * (b - a), a + g * (b - a)
            a, b = (a, d) if loss(c) < loss(d) else (c, b)
        powers.append((a + b) / 2)
        columns.append(moved(v, powers[-1]))
    z = np.stack(columns, 1)
    return Scaling(powers, z.mean(0), np.where(z.std(0) > 0, z.std(0), 1.0))


def transformed(x: np.ndarray) -> np.ndarray:
    """A table by the scaling that it determines itself."""
    return scaling(x)(x)


def macro_labels(x: np.ndarray, order: np.ndarray, k: int | None, seed: int, starts: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Labels and their probabilities; labels ascend with the mean of ``order``."""
    z = transformed(x)
    m = models.mixture(z, k, starts, seed) if k else models.mixture_by_bic(z, min(15, len(z) // 3), starts, seed)
    p = m.probabilities(z)
    labels = p.argmax(1)
    kinds = sorted(range(p.shape[1]), key=lambda c: order[labels == c].mean() if (labels == c).any() else math.inf)
    rank = np.argsort(kinds)
    return rank[labels], p.max(1)


def sub_labels(x: np.ndarray, order: np.ndarray, method: str = "hierarchical", least: float = 0.15, seed: int = 42) -> np.ndarray:
    """Sub-clusters of one macro cluster: the number of best silhouette, one if that is below ``least`` or a part has one row."""
    n = len(x)
    if n < 6:
        return np.zeros(n, int)
    z = transformed(x)
    tree = models.ward(z) if method == "hierarchical" else None
    make = {"hierarchical": lambda k: models.cut(tree, k), "gmm": lambda k: models.mixture(z, k, 5, seed).predict(z), "spectral": lambda k: models.spectral(z, k, seed=seed)}[method]
    best, score = np.zeros(n, int), least
    for k in range(2, min(n // 3, 8) + 1):
        labels = make(k)
        if np.bincount(labels).min() >= 2 and (s := models.silhouette(z, labels)) >= score:
            best, score = labels, s
    kinds = sorted(np.unique(best), key=lambda c: order[best == c].mean())
    return np.array([kinds.index(c) for c in best])


def nested(features: DataFrame, key: str = "sample_id", k: int | None = None, method: str = "hierarchical", seed: int = 42) -> DataFrame:
    """Adds macro_cluster, macro_cluster_prob, sub_cluster, full_label (A.1 and so on). More rows than ``ONE_TASK`` are spread over tasks, by
    the hierarchy only; other methods see all rows at once, and more than ``models.LARGEST`` raise."""
    ready = prepared(features, sorted({*MACRO, *SUB}))
    if method == "hierarchical":
        from .hierarchy import nested as spread

        ready = checkpointed(ready)
        if ready.count() > ONE_TASK:
            return spread(ready, MACRO, SUB, ORDER, k, seed)
    schema = T.StructType([*ready.schema.fields, T.StructField("macro_cluster", T.IntegerType()), T.StructField("macro_cluster_prob", T.DoubleType()), T.StructField("sub_cluster", T.IntegerType()), T.StructField("full_label", T.StringType())])

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(key, kind="stable").reset_index(drop=True)
        macro, p = macro_labels(t[MACRO].to_numpy(), t[ORDER].to_numpy(), k, seed)
        sub = np.zeros(len(t), int)
        for c in np.unique(macro):
            rows = macro == c
            sub[rows] = sub_labels(t.loc[rows, SUB].to_numpy(), t.loc[rows, SUB[0]].to_numpy(), method, seed=seed)
        return t.assign(macro_cluster=macro.astype("int32"), macro_cluster_prob=p, sub_cluster=sub.astype("int32"), full_label=[f"{chr(65 + a)}.{b + 1}" for a, b in zip(macro, sub, strict=True)])

    return ready.groupBy(F.lit("all")).applyInPandas(run, schema)


def subsample_bootstrap(features: DataFrame, key: str = "sample_id", n: int = 500, drop: float = 0.2, k: int = 2, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """One row for each iteration and row kept in it: iteration, key, label, reference, ari, bic_k.

    Rows go to iterations by the rank of a hash of (iteration, key); noise adds normal deviations of that share of a feature's
    own instead of, or besides, dropping.
    """
    ready = prepared(features, MACRO).select(key, *MACRO)
    spark = features.sparkSession
    copies = ready.crossJoin(F.broadcast(spark.range(n).select(F.col("id").cast("int").alias("iteration"))))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        it = int(t["iteration"].iloc[0])
        t = t.sort_values(key, kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, it])
        x = t[MACRO].to_numpy()
        full, _ = macro_labels(x, t[ORDER].to_numpy(), k, seed, 3)
        kept = np.sort(rng.permutation(len(t))[: max(2 * k, round((1 - drop) * len(t)))])
        moved = x[kept] + noise * x.std(0) * rng.standard_normal((len(kept), x.shape[1]))
        labels, _ = macro_labels(moved, moved[:, MACRO.index(ORDER)], k, it, 3)
        chosen = models.mixture_by_bic(transformed(moved), min(6, len(kept) // 3), 2, it, 1).means.shape[0]
        return pd.DataFrame({"iteration": it, key: t[key].to_numpy()[kept], "label": models.aligned(full[kept], labels), "reference": full[kept], "ari": models.adjusted_rand(full[kept], labels), "bic_k": chosen})

    return copies.groupBy("iteration").applyInPandas(run, f"iteration int, `{key}` {dict(features.dtypes)[key]}, label int, reference int, ari double, bic_k int")


def stability(runs: DataFrame, key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """Share of iterations in which a row keeps its label; and over iterations ARI and the number of clusters."""
    rows = runs.groupBy(key).agg(F.avg((F.col("label") == F.col("reference")).cast("double")).alias("stability"), F.count("*").alias("n"))
    its = runs.select("iteration", "ari", "bic_k").distinct()
    return rows, its.groupBy("bic_k").agg(F.count("*").alias("n"), F.avg("ari").alias("ari_mean"), F.stddev_pop("ari").alias("ari_std"), F.percentile("ari", 0.05).alias("ari_p5"), F.percentile("ari", 0.95).alias("ari_p95"))


def consensus(runs: DataFrame, key: str = "sample_id") -> DataFrame:
    """i, j, together, present: how often two rows of the table are in one cluster. Pairs of rows are the result, as a matrix."""
    a = runs.select("iteration", F.col(key).alias("i"), F.col("label").alias("li"))
    b = runs.select("iteration", F.col(key).alias("j"), F.col("label").alias("lj"))
    return a.join(b, "iteration").where("i < j").groupBy("i", "j").agg(F.count_if(F.col("li") == F.col("lj")).alias("together"), F.count("*").alias("present"))


def bounded(table: DataFrame, columns: list[str]) -> pd.DataFrame:
    """A feature table, one row for a curve, for a model that sees all of it; more rows than a model takes raise."""
    rows = table.select(*columns).limit(models.LARGEST + 1).toPandas()
    if len(rows) > models.LARGEST:
        raise ValueError(f"more than {models.LARGEST} rows are too many for one model")
    return rows


@dataclass
class MacroModel:
    """Scaling and mixture of a reference table; classes ascend with the mean of ORDER in it."""

    scale: Scaling
    mixture: models.Mixture
    kinds: list[int]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self.mixture.probabilities(self.scale(x))[:, self.kinds]


def macro_model(reference: DataFrame, k: int = 2, seed: int = 42) -> MacroModel:
    """Fitted on the reference rows alone, in a stable order."""
    table = bounded(reference, MACRO).dropna().sort_values(MACRO, kind="stable")
    scale = scaling(table[MACRO].to_numpy())
    m = models.mixture(scale(table[MACRO].to_numpy()), k, 10, seed)
    labels, order = m.predict(scale(table[MACRO].to_numpy())), table[ORDER].to_numpy()
    return MacroModel(scale, m, sorted(range(k), key=lambda c: order[labels == c].mean() if (labels == c).any() else math.inf))


def posteriors(rows: DataFrame, model: MacroModel, key: str = "sample_id") -> DataFrame:
    """key, macro_cluster, macro_cluster_prob and posterior_minority, the least posterior, of each row with all features."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for t in batches:
            p = held.value.probabilities(t[MACRO].to_numpy()) if len(t) else np.empty((0, 1))
            yield pd.DataFrame({key: t[key], "macro_cluster": p.argmax(1).astype("int32"), "macro_cluster_prob": p.max(1), "posterior_minority": p.min(1)})

    return rows.dropna(subset=MACRO).select(key, *MACRO).mapInPandas(run, f"`{key}` {dict(rows.dtypes)[key]}, macro_cluster int, macro_cluster_prob double, posterior_minority double")


def classify(new: DataFrame, reference: DataFrame, key: str = "sample_id", k: int = 5, classes: int = 2) -> DataFrame:
    """new: rows with the features. reference: clustered rows. The macro cluster and its probability come from a scaling and a mixture
    fitted on the reference alone, so a row's class does not depend on its batch; borderline below 0.6. The sub-label is the
    commonest one of the k nearest reference rows (scaled by the reference) that lie in that cluster, the nearest of equals, else the
    cluster's letter with a question mark."""
    from .statistics import nearest

    columns = sorted({*MACRO, *SUB})
    found = posteriors(new, macro_model(reference, classes), key)
    ends = reference.agg(*(F.avg(c).alias(f"a_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    vector = F.array(*((F.col(c) - ends[f"a_{c}"]) / (ends[f"s_{c}"] or 1.0) for c in columns)).alias("_v")
    held = reference.dropna(subset=columns)
    near = nearest(new.dropna(subset=columns).select(F.concat(F.lit("new|"), key).alias("_i"), vector), held.select(F.concat(F.lit("ref|"), key).alias("_i"), vector), "_i", "_v", k)
    voted = near.join(held.select(F.concat(F.lit("ref|"), key).alias("_i"), F.col("macro_cluster").alias("_c"), "full_label"), "_i")
    own = voted.join(found.select(F.concat(F.lit("new|"), key).alias("query"), "macro_cluster"), "query").where(F.col("_c") == F.col("macro_cluster"))
    votes = own.groupBy("query", "full_label").agg(F.count("*").alias("n"), F.min("distance").alias("d"))
    label = votes.groupBy("query").agg(F.max_by("full_label", F.struct("n", -F.col("d"))).alias("_label"))
    out = found.withColumn("query", F.concat(F.lit("new|"), key)).join(label, "query", "left")
    letter = F.concat(F.char(F.lit(65) + F.col("macro_cluster")), F.lit("?"))
    return out.select(key, "macro_cluster", F.col("macro_cluster_prob").alias("probability"), F.coalesce("_label", letter).alias("full_label"), (F.col("macro_cluster_prob") < 0.6).alias("borderline"))


def certain(rows: DataFrame, least: float = 0.7) -> DataFrame:
    """Adds certain: whether the cluster's probability is ``least`` or more; null probabilities are not."""
    return rows.withColumn("certain", F.coalesce(F.col("macro_cluster_prob") >= least, F.lit(False)))


def boundary_samples(rows: DataFrame, tags: DataFrame, names: list[str], key: str = "sample_id", n: int = 15) -> DataFrame:
    """The n rows of greatest ``posterior_minority`` (of equals the least key), with the tags of the first row that ``tags`` has for
    each; what is missing is unknown. A top-n report."""
    top = rows.orderBy(F.desc("posterior_minority"), key).limit(n)
    one = tags.groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(*names)).alias("_t"))
    return top.join(one, F.col(key) == F.col("_k"), "left").select(*rows.columns, *(F.coalesce(F.col("_t")[t], F.lit("unknown")).alias(t) for t in names))


def representatives(rows: DataFrame, cluster: str, columns: list[str], key: str) -> DataFrame:
    """Of each cluster the row nearest to its mean over the (scaled) columns, the least key of equals: cluster, key, distance, centre_*."""
    centres = rows.groupBy(cluster).agg(*(F.avg(c).alias("centre_" + c) for c in columns))
    far = F.sqrt(sum(((F.col(c) - F.col("centre_" + c)) * (F.col(c) - F.col("centre_" + c)) for c in columns), F.lit(0.0)))
    near = rows.join(centres, cluster).withColumn("distance", far)
    return near.groupBy(cluster).agg(F.min_by(F.struct(key, "distance", *("centre_" + c for c in columns)), F.struct(F.round("distance", 12), F.col(key))).alias("r")).select(cluster, "r.*")


def with_noise_split(features: DataFrame, columns: list[str], key: str = "sample_id", least_size: int = 5, samples: int = 2, most: int = 10, seed: int = 42) -> DataFrame:
    """Adds density (density cluster, -1 for noise) and combined, in which the noise, if it is six rows or more, is split by a mixture
    of lowest BIC into further clusters behind the others."""
    ready = features.dropna(subset=columns)
    schema = T.StructType([*ready.schema.fields, T.StructField("density", T.IntegerType()), T.StructField("combined", T.IntegerType())])

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(key, kind="stable").reset_index(drop=True)
        z = transformed(t[columns].to_numpy())
        found = models.hdbscan(z, least_size, samples)
        combined, noise = found.copy(), found == -1
        if noise.sum() >= 6:
            combined[noise] = models.mixture_by_bic(z[noise], min(most, int(noise.sum()) // 3), 5, seed).predict(z[noise]) + found.max() + 1
        return t.assign(density=found.astype("int32"), combined=combined.astype("int32"))

    return ready.groupBy(F.lit("all")).applyInPandas(run, schema)


def alternative_subclusters(features: DataFrame, key: str = "sample_id", macro: int = 1, methods: tuple[str, ...] = ("hierarchical", "gmm", "spectral"), seed: int = 42) -> DataFrame:
    """Sub-clusters of one macro cluster by each method: method, key, sub_cluster, n_clusters, silhouette (null for one cluster). A group
    of its own for each method."""
    ready = prepared(features, sorted({*MACRO, *SUB})).where(F.col("macro_cluster") == macro).select(key, *SUB)
    copies = ready.crossJoin(F.broadcast(features.sparkSession.createDataFrame([(m,) for m in methods], "method string")))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(key, kind="stable").reset_index(drop=True)
        method, x = t["method"].iloc[0], t[SUB].to_numpy()
        labels = sub_labels(x, t[SUB[0]].to_numpy(), method, seed=seed)
        score = models.silhouette(transformed(x), labels) if labels.max() > 0 else None
        return pd.DataFrame({"method": method, key: t[key], "sub_cluster": labels.astype("int32"), "n_clusters": int(labels.max()) + 1, "silhouette": score})

    return copies.groupBy("method").applyInPandas(run, f"method string, `{key}` {dict(features.dtypes)[key]}, sub_cluster int, n_clusters int, silhouette double")


def nested_bootstrap(clustered: DataFrame, key: str = "sample_id", n: int = 300, drop: float = 0.2, seed: int = 42) -> DataFrame:
    """Clusters and sub-clusters resampled together. clustered: the features with macro_cluster and full_label. Each iteration, a group of
    its own, drops a share of the rows, finds two macro clusters anew, and splits the second by spectral clustering in two. Returns
    iteration, key, full_label, reference, macro_ari, full_ari, sub_k for each row kept; ``bootstrap_stability`` sums up."""
    columns = sorted({*MACRO, *SUB})
    ready = prepared(clustered, columns).select(key, *columns, F.col("macro_cluster").alias("_m"), F.col("full_label").alias("_l"))
    copies = ready.crossJoin(F.broadcast(clustered.sparkSession.range(n).select(F.col("id").cast("int").alias("iteration"))))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        it = int(t["iteration"].iloc[0])
        t = t.sort_values(key, kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, it])
        t = t.iloc[np.sort(rng.permutation(len(t))[: max(4, int(len(t) * (1 - drop)))])].reset_index(drop=True)
        macro, _ = macro_labels(t[MACRO].to_numpy(), t[ORDER].to_numpy(), 2, it, 3)
        old = t["_m"].to_numpy()
        macro = models.aligned(old, macro)
        second, sub_k = macro == 1, 1
        labels = np.where(second, "B.1", "A").astype(object)
        if second.sum() >= 6:
            x = t.loc[second, SUB].to_numpy()
            sub, order = models.spectral(transformed(x), 2, seed=it), t.loc[second, ORDER].to_numpy()
            if (sub == 0).any() and (sub == 1).any():
                if order[sub == 0].mean() > order[sub == 1].mean():
                    sub = 1 - sub
                labels[second], sub_k = np.where(sub == 0, "B.1", "B.2"), 2
        ids = {x: i for i, x in enumerate(sorted({*labels, *t["_l"]}))}
        number = lambda v: np.array([ids[x] for x in v])
        return pd.DataFrame({"iteration": it, key: t[key], "full_label": labels, "reference": t["_l"], "macro_ari": models.adjusted_rand(old, macro), "full_ari": models.adjusted_rand(number(t["_l"]), number(labels)), "sub_k": sub_k})

    return copies.groupBy("iteration").applyInPandas(run, f"iteration int, `{key}` {dict(clustered.dtypes)[key]}, full_label string, reference string, macro_ari double, full_ari double, sub_k int")


def bootstrap_stability(runs: DataFrame, key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """For each row the share of iterations, of those that kept it, in which its full label was the same; and mean, deviation and 5th
    and 95th percentile of both ARIs, with the share of iterations that split the second cluster."""
    rows = runs.groupBy(key).agg(F.avg((F.col("full_label") == F.col("reference")).cast("double")).alias("stability"), F.count("*").alias("n"))
    its = runs.groupBy("iteration").agg(F.first("macro_ari").alias("macro_ari"), F.first("full_ari").alias("full_ari"), F.first("sub_k").alias("sub_k"))
    parts = [x for c in ("macro_ari", "full_ari") for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.percentile(c, 0.05).alias(f"{c}_p5"), F.percentile(c, 0.95).alias(f"{c}_p95"))]
    return rows, its.agg(F.count("*").alias("n"), *parts, F.avg((F.col("sub_k") > 1).cast("double")).alias("split"))


def perturbed(points: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """Points of each curve, perturbed n times in each of three modes: noise of 2 %, 85 % of the points, another smoothing.
    sample_id becomes sample|mode|iteration, ready for ``curves.features``."""
    spark = points.sparkSession
    grid = spark.range(n).select(F.col("id").cast("int").alias("iteration")).crossJoin(spark.createDataFrame([("noise",), ("dropout",), ("smooth",)], "mode string"))
    every = points.select("sample_id", "energy", "absorbance").crossJoin(F.broadcast(grid))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("energy", kind="stable").reset_index(drop=True)
        name, mode, it = t["sample_id"].iloc[0], t["mode"].iloc[0], int(t["iteration"].iloc[0])
        rng = np.random.default_rng([seed, it, sum(name.encode()) & 0xFFFF, len(mode)])
        a = t["absorbance"].to_numpy()
        if mode == "noise":
            t["absorbance"] = np.maximum(1e-12, a + 0.02 * np.maximum(np.abs(a), np.percentile(np.abs(a), 5)) * rng.standard_normal(len(a)))
        elif mode == "dropout":
            t = t.loc[np.sort(rng.permutation(len(t))[: max(30, int(0.85 * len(t)))])]
        else:
            t["absorbance"] = np.maximum(1e-12, fit.savgol(a, int(rng.choice([5, 7, 9, 11, 13]))))
        return pd.DataFrame({"sample_id": f"{name}|{mode}|{it}", "energy": t["energy"].to_numpy(), "absorbance": t["absorbance"].to_numpy()})

    return every.groupBy("sample_id", "mode", "iteration").applyInPandas(run, "sample_id string, energy double, absorbance double")


def perturbation_summary(found: DataFrame, columns: tuple[str, ...] = ("E_g_eV", "E_u_meV", "A_sub")) -> DataFrame:
    """mean, deviation, 5th and 95th percentile of each feature, curve and mode with three results or more."""
    parts = F.split("sample_id", r"\|")
    long = found.where("status = 'ok'").select(F.get(parts, F.lit(0)).alias("sample"), F.get(parts, F.lit(1)).alias("mode"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns))).alias("x")).select("sample", "mode", "x.*")
    out = long.groupBy("sample", "mode", "feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.percentile("value", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    return out.where("n >= 3").select("sample", "mode", "feature", "n", "mean", "std", F.get("q", F.lit(0)).alias("p5"), F.get("q", F.lit(1)).alias("p95"))


def crossings(trans: DataFrame, reference: DataFrame, directions: int = 2000, seed: int = 42, steps: int = 64) -> DataFrame:
    """Of each pair (ref_x, ref_y, mod_x, mod_y, id): whether it crosses the border of two classes (x, y, side = -1 or 1), and
    the share of random directions of the same length that would. The border is that of a kernel classifier; the reference is a
    bounded table, broadcast as its model."""
    table = bounded(reference, ["x", "y", "side"])
    model = models.kernel_classifier(table[["x", "y"]].to_numpy(float), table["side"].to_numpy(float))

    def run(batches):
        turns = np.linspace(0, 2 * math.pi, directions, endpoint=False)
        ring = np.stack([np.cos(turns), np.sin(turns)], 1)
        for t in batches:
            a, b = t[["ref_x", "ref_y"]].to_numpy(float), t[["mod_x", "mod_y"]].to_numpy(float)
            side, length = np.sign(model.decide(a)), np.sqrt(((b - a) ** 2).sum(1))
            expected = [float((np.sign(model.decide(p + r * ring)) != s).mean()) for p, r, s in zip(a, length, side, strict=True)]
            yield pd.DataFrame({"id": t["id"], "crosses": side != np.sign(model.decide(b)), "expected": expected, "length": length})

    return trans.select("id", "ref_x", "ref_y", "mod_x", "mod_y").mapInPandas(run, f"id {dict(trans.dtypes)['id']}, crosses boolean, expected double, length double")


#: Cells of the grid on which a border is looked for, each way.
GRID = 400


def border_points(model, x: np.ndarray, factor: float = 1.5, cells: int = GRID) -> np.ndarray:
    """Points of a grid over the rows, widened by ``factor``, whose class differs from that of the grid point below or left of it.

    model: maps points to labels.
    """
    low, high = x.min(0), x.max(0)
    margin = (high - low) * (factor - 1) / 2
    axes = [np.linspace(a - m, b + m, cells) for a, b, m in zip(low, high, margin, strict=True)]
    grid = np.stack(np.meshgrid(*axes), -1)
    labels = np.asarray(model(grid.reshape(-1, 2))).reshape(cells, cells)
    edge = np.zeros_like(labels, bool)
    edge[1:] |= labels[1:] != labels[:-1]
    edge[:, 1:] |= labels[:, 1:] != labels[:, :-1]
    return grid[edge]


def border_distances(rows: DataFrame, reference: DataFrame, key: str = "id") -> DataFrame:
    """key, distance to the nearest grid point of the border between the two classes of ``reference`` (x, y, side = -1 or 1), and side,
    for rows with x and y; a null distance where there is no border. The grid's border is bounded and goes to every task."""
    table = bounded(reference, ["x", "y", "side"])
    model = models.kernel_classifier(table[["x", "y"]].to_numpy(float), table["side"].to_numpy(float))
    border = border_points(lambda p: np.sign(model.decide(p)), table[["x", "y"]].to_numpy(float))

    def run(batches):
        for t in batches:
            p = t[["x", "y"]].to_numpy(float)
            least = np.full(len(p), np.inf)
            for part in np.array_split(border, max(1, len(border) // 256)) if len(border) else []:
                least = np.minimum(least, models.distances(p, part).min(1))
            yield pd.DataFrame({key: t[key], "distance": np.where(np.isfinite(least), least, np.nan), "side": np.sign(model.decide(p)).astype("int32")})

    return rows.select(key, "x", "y").mapInPandas(run, f"`{key}` {dict(rows.dtypes)[key]}, distance double, side int")

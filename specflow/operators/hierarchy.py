"""Nested clusters of a feature table of any size: what ``clusters.nested`` does in one task for a small one.

Equal rows are one spot with a weight. Powers of the scaling, k-means, and expectation and maximisation take one pass over the spots a
round, for all starts together; only sums of a task reach the driver. Ward's tree is needed from its top only. It is built bottom-up in cells:
two clusters of a cell that are each other's nearest, nearer than anything outside the cell can be to either, merge in Ward's tree whatever
happens elsewhere, since merging others brings nothing closer. What is left is dealt into new cells, until one bounded task can take the rest.
The mean silhouette of the cuts is exact: distances of all pairs of spots, block against block, summed by the finest cut's clusters.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import models
from ..session import checkpointed
from . import clusters
from .cells import Cells

#: Clusters that the last task of Ward's tree takes, of a cell before that, and that a cell keeps at least.
LAST, CELL, KEPT = 8192, 1024, 64
#: Spots of a task, and of a block whose distances are taken to another's.
TASK, BLOCK = 16_384, 8192
#: Clusters that cells are learned from (about as many), and distances that are held at once.
SAMPLE, TILE = 1 << 16, 1 << 20
#: Powers that are tried at once, and how often their range is narrowed.
POWERS, ROUNDS = 33, 5


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows written, in tasks of bounded size."""
    held = checkpointed(rows)
    return checkpointed(held.repartition(max(1, -(-held.count() // TASK)), *keys))


def sums(rows: DataFrame, names: list[str], of) -> np.ndarray:
    """The sum of of(x, w) over batches: one row of each task reaches the driver."""

    def run(stream):
        total = None
        for batch in stream:
            if batch.num_rows:
                columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
                part = of(np.stack(columns[:-1], 1), columns[-1])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    return np.sum([r["s"] for r in rows.select(*names, "w").mapInArrow(run, "s array<double>").collect()], axis=0)


def with_columns(rows: DataFrame, names: list[str], of, made: str) -> DataFrame:
    """Adds the columns that of(x) gives, as a schema in ``made`` names them."""
    fields = rows.schema.names

    def run(stream):
        for batch in stream:
            x = np.stack([batch.column(fields.index(n)).to_numpy(zero_copy_only=False).astype(float) for n in names], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in of(x))], names=[*fields, *(c.split()[0] for c in made.split(", "))])

    return rows.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes), made]))


def scaling(rows: DataFrame, names: list[str]) -> clusters.Scaling:
    """As ``clusters.scaling``: the likelihood of a grid of powers in a pass, which is narrowed."""
    width = len(names)
    first = sums(rows, names, lambda x, w: np.concatenate([[w.sum()], w @ x, w @ (np.sign(x) * np.log1p(np.abs(x)))]))
    n, mean, weight = first[0], first[1 : 1 + width] / first[0], first[1 + width :]

    def moments(powers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and variance of each column by each of its powers, from sums about a point near the mean."""
        about = np.array([[clusters.moved(mean[j : j + 1], p)[0] for p in powers[j]] for j in range(width)])

        def of(x, w):
            off = np.stack([np.stack([clusters.moved(x[:, j], p) for p in powers[j]]) - about[j][:, None] for j in range(width)])
            return np.concatenate([(off @ w).ravel(), (off * off @ w).ravel()])

        s = sums(rows, names, of).reshape(2, *about.shape) / n
        return about + s[0], np.maximum(0, s[1] - s[0] ** 2)

    low, high = np.full(width, -3.0), np.full(width, 5.0)
    for _ in range(ROUNDS):
        grid = np.linspace(low, high, POWERS, axis=1)
        loss = n / 2 * np.log(np.maximum(1e-300, moments(grid)[1])) - (grid - 1) * weight[:, None]
        best = loss.argmin(1)
        found = grid[np.arange(width), best]
        low, high = (grid[np.arange(width), np.clip(best + step, 0, POWERS - 1)] for step in (-1, 1))
    means, variances = moments(found[:, None])
    deviations = np.sqrt(variances[:, 0])
    return clusters.Scaling(found.tolist(), means[:, 0], np.where(deviations > 0, deviations, 1.0))


def numbers(x: np.ndarray, seed: int) -> np.ndarray:
    """A number between 0 and 1 of each row, by its bits and a seed, so that it does not depend on how rows are dealt."""
    h = np.full(len(x), (seed * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1), np.uint64)
    for column in (x + 0.0).T:
        h = (h ^ np.ascontiguousarray(column).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return ((h >> np.uint64(11)).astype(float) + 0.5) / 2**53


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to the centres (starts, k, width) of all starts: (starts, rows, k)."""
    return ((x[None, :, None, :] - centres[:, None]) ** 2).sum(3)


def first_centres(rows: DataFrame, names: list[str], k: int, starts: int, seed: int) -> np.ndarray:
    """Centres of each start, one after the other by weight times squared distance to those there are: the row that comes first if each
    waits a random time of that rate. A row of each task and start reaches the driver."""
    centres = np.empty((starts, 0, len(names)))
    for step in range(k):

        def run(stream, centres=centres, step=step):
            best = [(math.inf, None)] * starts
            for batch in stream:
                if batch.num_rows:
                    columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
                    x, w = np.stack(columns[:-1], 1), columns[-1]
                    far = squares(x, centres).min(2) if step else np.ones((starts, len(x)))
                    for s in range(starts):
                        wait = -np.log(numbers(x, (seed * 1000 + s) * 100 + step)) / np.maximum(1e-300, w * far[s])
                        i = int(wait.argmin())
                        best[s] = min(best[s], (float(wait[i]), x[i].tolist()))
            found = [(s, t, x) for s, (t, x) in enumerate(best) if x is not None]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.list_(pa.float64()))], names=["s", "t", "x"])

        got = rows.select(*names, "w").mapInArrow(run, "s int, t double, x array<double>").collect()
        chosen = [min((r["t"], r["x"]) for r in got if r["s"] == s)[1] for s in range(starts)]
        centres = np.concatenate([centres, np.array(chosen)[:, None]], 1)
    return centres


def mixture(rows: DataFrame, names: list[str], k: int, starts: int = 10, seed: int = 42, rounds: int = 200, floor: float = 1e-6) -> models.Mixture:
    """As ``models.mixture``, the starts together, a pass a round."""
    d, n = len(names), float(sums(rows, names, lambda x, w: w.sum(keepdims=True))[0])
    pair = np.triu_indices(d)

    def parted(r, x, w):
        """Sums of r, r x and r x x over rows, for r (starts, rows, k)."""
        basis = np.concatenate([np.ones((len(x), 1)), x, x[:, pair[0]] * x[:, pair[1]]], 1)
        return (r * w[None, :, None]).transpose(0, 2, 1) @ basis

    def parameters(t):
        size = t[..., 0] + 1e-10
        means = t[..., 1 : 1 + d] / size[..., None]
        cov = np.empty((*size.shape, d, d))
        second = t[..., 1 + d :] / size[..., None] - means[..., pair[0]] * means[..., pair[1]] * (2 - t[..., 0] / size)[..., None]
        cov[..., pair[0], pair[1]] = second
        cov[..., pair[1], pair[0]] = second
        return size / n, means, cov + floor * np.eye(d)

    terms = 1 + d + len(pair[0])
    centres = first_centres(rows, names, k, starts, seed)
    for _ in range(100):
        labelled = lambda x, w, c=centres: parted(np.eye(k)[squares(x, c).argmin(2)], x, w).ravel()
        t = sums(rows, names, labelled).reshape(starts, k, terms)
        new = np.where(t[..., :1] > 0, t[..., 1 : 1 + d] / np.maximum(t[..., :1], 1e-300), centres)
        if np.allclose(new, centres):
            break
        centres = new
    made, going = {}, list(range(starts))
    last, now = np.full(starts, -math.inf), parameters(t)
    for turn in range(rounds):
        held = [models.Mixture(*(v[i] for v in now), 0.0) for i in range(len(going))]

        def expected(x, w, held=held):
            parts, level = [], []
            for m in held:
                p = m.log_parts(x)
                top = p.max(1, keepdims=True)
                total = top[:, 0] + np.log(np.exp(p - top).sum(1))
                parts.append(np.exp(p - total[:, None]))
                level.append(total @ w)
            return np.concatenate([level, parted(np.stack(parts), x, w).ravel()])

        got = sums(rows, names, expected)
        level, t, left = got[: len(held)], got[len(held) :].reshape(len(held), k, terms), []
        for i, s in enumerate(going):
            made[s] = models.Mixture(held[i].weights, held[i].means, held[i].covariances, float(level[i]))
            if level[i] - last[s] >= 1e-6 * n and turn < rounds - 1:
                left.append(i)
            last[s] = level[i]
        if not left:
            break
        going, now = [going[i] for i in left], parameters(t[left])
    return max((made[s] for s in range(starts)), key=lambda m: m.log_likelihood)


def outside(x: np.ndarray, w: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
    """What Ward's distance of clusters to any cluster of other cells is at least, by the boxes and least weights of those."""
    if not len(low):
        return np.full(len(x), np.inf)
    out = np.empty(len(x))
    for a in range(0, len(x), step := max(1, TILE // len(low))):
        part, own = x[a : a + step, None], w[a : a + step, None]
        gap = (np.maximum(0, np.maximum(low - part, part - high)) ** 2).sum(2)
        out[a : a + step] = (2 * own * least / (own + least) * gap).min(1)
    return out


def settled(x: np.ndarray, w: np.ndarray, bound, cap: float, keep: int) -> tuple[np.ndarray, float]:
    """Of clusters of a cell: the group of each after merges that Ward's tree has whatever lies outside, lowest first, as long as ``keep`` are left and none is above ``cap``; and the highest of them."""
    n = len(x)
    merges = models.chained(x, w, bound)
    merges = sorted((m for m in merges if m[2] < cap), key=lambda m: m[2])[: max(0, n - keep)]
    parent = np.arange(2 * n)
    for a, b, _, new in merges:
        parent[a] = parent[b] = new
    while (parent != parent[parent]).any():
        parent = parent[parent]
    return parent[:n], max((m[2] for m in merges), default=0.0)


def merged(spots: DataFrame, names: list[str], cap: float) -> tuple[DataFrame, DataFrame, float]:
    """spots: i, names, w. Returns what is left for the last task (the same columns), the cluster ``to`` that each spot i is in, and the highest merge."""
    left, held, highest, cell = spots.select("i", *names, "w"), spots.select("i", F.col("i").alias("to")), 0.0, CELL
    d, count = len(names), spots.count()
    while count > LAST:
        part = int(min(1.0, SAMPLE / count) * (1 << 31))
        few = left.where(F.pmod(F.xxhash64("i"), F.lit(1 << 31)) <= part).select(*names).limit(2 * SAMPLE).toArrow()
        tree = Cells(np.stack([few[c].to_numpy() for c in names], 1), min(max(2, len(few) // 4), -(-count // cell)))
        placed = checkpointed(with_columns(left, names, lambda x, tree=tree: [tree.of(x)], "cell bigint"))
        boxes = placed.groupBy("cell").agg(F.min("w").alias("w"), *(f(c).alias(f.__name__ + c) for c in names for f in (F.min, F.max))).orderBy("cell").collect()  # a row a cell
        cells, least = np.array([b["cell"] for b in boxes]), np.array([b["w"] for b in boxes], float)
        low, high = (np.array([[b[f + c] for c in names] for b in boxes]) for f in ("min", "max"))

        def run(stream, cells=cells, least=least, low=low, high=high):
            for batch in stream:
                for at, of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    of = sorted(of, key=lambda r: r["i"])
                    x, w = np.array([[r[c] for c in names] for r in of]), np.array([r["w"] for r in of], float)
                    rest = cells != at
                    groups, top = settled(x, w, lambda p, q: outside(p, q, low[rest], high[rest], least[rest]), cap, KEPT)
                    _, first, group = np.unique(groups, return_index=True, return_inverse=True)
                    size = np.bincount(group, w)
                    centre = [np.bincount(group, w * x[:, c]) / size for c in range(d)]
                    out = [pa.array([r["i"] for r in of], pa.int64()), pa.array([of[f]["i"] for f in first[group]], pa.int64()), *(pa.array(c[group]) for c in centre), pa.array(size[group]), pa.array(np.full(len(of), top))]
                    yield pa.RecordBatch.from_arrays(out, names=["i", "to", *names, "w", "top"])

        grouped = placed.groupBy("cell").agg(F.collect_list(F.struct("i", *names, "w")).alias("of")).repartition(len(boxes), "cell")
        made = checkpointed(grouped.mapInArrow(run, f"i bigint, to bigint, {', '.join(c + ' double' for c in names)}, w double, top double"))
        highest = max(highest, made.agg(F.max("top")).first()[0])
        held = checkpointed(held.withColumnRenamed("to", "was").join(made.select(F.col("i").alias("was"), "to"), "was").select("i", "to"))
        left = spread(made.where("i = to").select("i", *names, "w"), "i")
        before, count = count, left.count()
        if count > 0.8 * before:
            if cell >= LAST:
                break
            cell = min(LAST, 2 * cell)
    if count > models.LARGEST:
        raise ValueError(f"{count} clusters are left of which none is surely the nearest of its nearest")
    return left, held, highest


def cuts(spots: DataFrame, names: list[str], most: int) -> tuple[DataFrame, np.ndarray]:
    """i, fine: the clusters, of ``most``, of each spot by Ward's tree; and for each smaller number, from 2, the clusters that those become."""
    cap = math.inf
    while True:
        left, held, highest = merged(spots, names, cap)
        rows = left.orderBy("i").toArrow()  # bounded
        x, w = np.stack([rows[c].to_numpy() for c in names], 1), rows["w"].to_numpy().astype(float)
        tree = models.ward(x, w)
        need = tree[len(tree) - most + 1, 2] ** 2 if len(tree) >= most - 1 else 0.0
        if highest <= need:
            break
        cap = need if need > 0 else highest / 4  # a merge in a cell is among the last of all: these must be the last task's
    fine = models.cut(tree, most)
    first = np.unique(fine, return_index=True)[1]
    coarse = np.array([models.cut(tree, k)[first] for k in range(2, most + 1)])
    schema = "to bigint, fine int"
    named = spots.sparkSession.createDataFrame(pa.table({"to": rows["i"], "fine": pa.array(fine, pa.int32())}), schema)
    return held.join(named, "to").select("i", "fine"), coarse


def distances_to(spots: DataFrame, names: list[str], parts: int) -> DataFrame:
    """i, far: the sums of the distances of each spot to all rows of each of ``parts`` clusters; all pairs, block against block."""
    blocks = -(-spots.count() // BLOCK)
    dealt = spots.groupBy(F.pmod(F.xxhash64("i"), F.lit(blocks)).alias("b")).agg(F.collect_list(F.struct("i", *names, "w", "fine")).alias("of"))
    dealt = checkpointed(dealt)
    pairs = dealt.select(F.col("of").alias("left"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("b")).join(dealt.select("b", F.col("of").alias("right")), "b")

    def run(stream):
        for batch in stream:
            for at in range(batch.num_rows):
                left, right = (batch.column(batch.schema.get_field_index(side)).slice(at, 1).flatten() for side in ("left", "right"))
                x, y = (np.stack([side.field(c).to_numpy(zero_copy_only=False) for c in names], 1) for side in (left, right))
                fine, w = right.field("fine").to_numpy(), right.field("w").to_numpy().astype(float)
                member = np.zeros((len(y), parts))
                member[np.arange(len(y)), fine] = w
                out = np.empty((len(x), parts))
                for a in range(0, len(x), step := max(1, TILE // len(y))):
                    out[a : a + step] = np.sqrt(sum((x[a : a + step, c, None] - y[:, c]) ** 2 for c in range(len(names)))) @ member
                yield pa.RecordBatch.from_arrays([left.field("i"), *(pa.array(c) for c in out.T)], names=["i", *(f"d{c}" for c in range(parts))])

    found = pairs.repartition(max(1, blocks * blocks), F.rand(1)).select("left", "right").mapInArrow(run, "i bigint, " + ", ".join(f"d{c} double" for c in range(parts)))
    return found.groupBy("i").agg(*(F.sum(f"d{c}").alias(f"d{c}") for c in range(parts)))


def subdivided(rows: DataFrame, columns: list[str], most: int = 8, least: float = 0.15) -> DataFrame:
    """rows: columns, w (how many are alike). Adds ``sub``: as ``clusters.sub_labels``, the hierarchy's cut of best silhouette."""
    n = int(rows.agg(F.sum("w")).first()[0])
    spots = spread(rows.groupBy(*columns).agg(F.sum("w").alias("w")), *columns)
    most = min(n // 3, most, spots.count())
    if n < 6 or most < 2:
        return rows.withColumn("sub", F.lit(0))
    names = [f"z{j}" for j in range(len(columns))]
    placed = with_columns(spots, columns, lambda x, scale=scaling(spots, columns): list(scale(x).T), ", ".join(c + " double" for c in names))
    placed = checkpointed(placed.withColumn("i", F.monotonically_increasing_id()))
    fine, coarse = cuts(placed, names, most)
    labelled = spread(placed.join(fine, "i"), "i")
    sizes = np.zeros(most)
    for r in labelled.groupBy("fine").agg(F.sum("w").alias("n")).collect():
        sizes[r["fine"]] = r["n"]
    far = labelled.select("i", "w", "fine").join(distances_to(labelled, names, most), "i")

    def scored(x, w):
        out, own = [], x[:, 0].astype(int)
        for k, to in zip(range(2, most + 1), coarse):
            member = np.eye(k)[to]
            mean, size, mine, at = x[:, 1:] @ member, sizes @ member, to[own], np.arange(len(x))
            a, other = mean[at, mine] / np.maximum(1, size[mine] - 1), mean / size
            other[at, mine] = np.inf
            b = other.min(1)
            out.append(float(w @ np.where(size[mine] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0)))
        return np.array(out)

    scores, best = sums(far, ["fine", *(f"d{c}" for c in range(most))], scored) / n, None
    for k, to in zip(range(2, most + 1), coarse):
        if (sizes @ np.eye(k)[to]).min() >= 2 and scores[k - 2] >= least:
            best, least = to, scores[k - 2]
    if best is None:
        return rows.withColumn("sub", F.lit(0))
    total = {r["fine"]: r["s"] for r in labelled.groupBy("fine").agg(F.sum(F.col(columns[0]) * F.col("w")).alias("s")).collect()}
    kinds = range(best.max() + 1)
    mean = [sum(total[c] for c in range(most) if best[c] == g) / sizes[best == g].sum() for g in kinds]
    rank = np.argsort(sorted(kinds, key=mean.__getitem__))
    named = F.array(*(F.lit(int(rank[best[c]])) for c in range(most)))
    return rows.join(labelled.select(*columns, F.get(named, F.col("fine")).alias("sub")), columns)


def nested(ready: DataFrame, macro: list[str], sub: list[str], order: str, k: int | None, seed: int) -> DataFrame:
    """ready: all macro and sub columns, without nulls. Adds macro_cluster, macro_cluster_prob, sub_cluster, full_label."""
    columns = sorted({*macro, *sub})
    spots = spread(ready.groupBy(*(F.col(c).cast("double").alias(c) for c in columns)).agg(F.count("*").cast("double").alias("w")), *columns)
    names = [f"z{j}" for j in range(len(macro))]
    placed = checkpointed(with_columns(spots, macro, lambda x, scale=scaling(spots, macro): list(scale(x).T), ", ".join(c + " double" for c in names)))
    n = int(placed.agg(F.sum("w")).first()[0])
    made = [mixture(placed, names, parts, 10, seed) for parts in ([k] if k else range(2, 16))]
    model = min(made, key=lambda m: m.bic(n))
    found = checkpointed(with_columns(placed, names, lambda x: [(p := model.probabilities(x)).argmax(1).astype("int32"), p.max(1)], "part int, macro_cluster_prob double"))
    mean = {r["part"]: r["m"] for r in found.groupBy("part").agg((F.sum(F.col(order) * F.col("w")) / F.sum("w")).alias("m")).collect()}
    kinds = sorted(range(len(model.weights)), key=lambda c: mean.get(c, math.inf))
    out = None
    for at, part in enumerate(kinds):
        if part in mean:
            rows = found.where(F.col("part") == part).select(*columns, "w", "macro_cluster_prob", F.lit(at).alias("macro_cluster"))
            one = subdivided(rows, sub).select(*columns, "macro_cluster", "macro_cluster_prob", F.col("sub").alias("sub_cluster"))
            out = one if out is None else out.unionByName(one)
    label = F.concat(F.char(F.lit(65) + F.col("macro_cluster")), F.lit("."), (F.col("sub_cluster") + 1).cast("string"))
    renamed = out.select(*(F.col(c).alias("_" + c) for c in columns), "macro_cluster", "macro_cluster_prob", "sub_cluster", label.alias("full_label"))
    alike = [F.col(c).cast("double") == F.col("_" + c) for c in columns]
    return ready.join(renamed, alike).drop(*("_" + c for c in columns))

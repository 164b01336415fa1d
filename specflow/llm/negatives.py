"""Hard-negative mining: exact best partners by integer inner product, most pairs discarded on a few rotated components.

A row is an id, a label and a vector; a component x counts as floor(256 x). Rows without id, label or vector, with a null or
non-finite component, or with one beyond 2**20 (products would leave 64 bits) take no part. A shorter vector has zeros at its end.
Other rows are those of another id: rows that repeat an id are rows of their own, as anchors and as partners, but no row is a
partner of its own id.

A row's vector is rotated by an orthogonal matrix, the principal axes of a bounded sample. The product of the leading components of
two rows, with the product of the norms of what is left and a slack for rounding, bounds their score from both sides. Pairs whose
bounds leave no place in a list are discarded after the first level of components, or after the next; what survives is verified by
products of integers. A list starts at what the sample alone guarantees, so that even the first rows can be discarded.

Anchors come in chunks of a bounded number, each sent to all tasks; a task scans its own rows in tiles against them and returns only
lists of ``k`` a chunk, which Spark merges. So the table is read twice a chunk and never shuffled, and no list or label, however common,
is anywhere as a whole. Results of a chunk are written to the shared folder. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, sampled, scratch

#: Anchors sent to all tasks at once; with ``SAMPLE``, what bounds the driver's memory.
CHUNK = 8192
#: Rows, chosen by a hash of their content, that the rotation and the first limits are learned from.
SAMPLE = 4096
#: Fixed value: a component is floor(SCALE * x).
SCALE = 256.0
#: Largest magnitude of a component after scaling: 2**28 and 64 components keep a product below 2**62.
LARGEST = 1 << 28
#: Cells of a tile of rows against anchors.
TILE = 1 << 21
#: Shares of the sample's energy that the levels before the last hold.
LEVELS = (0.5, 0.85)
NONE = np.iinfo(np.int64).min


def usable(rows: DataFrame, key: str, label: str, vector: str, anchors: Column) -> DataFrame:
    """id, label, x (scaled components) and anchor of the rows that take part."""
    x = F.transform(F.col(vector), lambda c: F.floor(F.lit(SCALE) * c.cast("double")))
    fine = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) <= LARGEST / SCALE))
    known = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & fine)
    return known.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), x.alias("x"), F.coalesce(anchors, F.lit(False)).alias("anchor"))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """A list column as rows of ``dims`` integers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n, out = np.diff(column.offsets.to_numpy()), np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < n[:, None]] = column.flatten().to_numpy()
    return out


class Rotated:
    """Vectors with their rotated components, the norms of these beyond each level, and the whole norms."""

    def __init__(self, x: np.ndarray, rotation: np.ndarray, levels: list[int]):
        self.x, self.y = x, x.astype(np.float64) @ rotation
        self.norm = np.sqrt((self.y**2).sum(1))
        self.rest = np.stack([np.sqrt((self.y[:, m:] ** 2).sum(1)) for m in levels])

    def part(self, rows) -> Rotated:
        out = object.__new__(Rotated)
        out.x, out.y, out.norm, out.rest = self.x[rows], self.y[rows], self.norm[rows], self.rest[:, rows]
        return out


def learned(x: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The principal axes of a sample and the numbers of components at which bounds are looked at."""
    values, axes = np.linalg.eigh(x.T.astype(np.float64) @ x)
    energy = np.maximum(values[::-1], 0).cumsum()
    at = [int(np.searchsorted(energy, s * energy[-1])) + 1 for s in LEVELS]
    return axes[:, ::-1].copy(), sorted({*(min(m, x.shape[1]) for m in at), x.shape[1]})


def slack(dims: int) -> float:
    """Rounding of a product of two vectors of norm 1, rotated: some units in the last place for each component."""
    return 64 * (dims + 16) * np.finfo(np.float64).eps


def survivors(rows: Rotated, anchors: Rotated, levels: list[int], need: np.ndarray, most: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, anchor) of the pairs whose score may be from need to most of the anchor. Products accumulate level by level, for
    the whole tile as long as an eighth of it is left, then pair by pair."""
    eps, done, part, pairs = slack(rows.y.shape[1]), 0, 0.0, None
    for level, m in enumerate(levels):
        if pairs is None:
            part = part + rows.y[:, done:m] @ anchors.y[:, done:m].T
            room = np.outer(rows.rest[level], anchors.rest[level]) + np.outer(eps * rows.norm, anchors.norm)
            left = (part + room >= need) & (part - room <= most)
            if allowed is not None:
                left &= allowed
            if 8 * np.count_nonzero(left) < left.size or m == levels[-1]:
                pairs = np.nonzero(left)
                part = part[pairs]
        else:
            i, j = pairs
            for a in range(0, len(i), 1 << 16):
                b = slice(a, a + (1 << 16))
                part[b] += np.einsum("ij,ij->i", rows.y[i[b], done:m], anchors.y[j[b], done:m])
            room = rows.rest[level, i] * anchors.rest[level, j] + eps * rows.norm[i] * anchors.norm[j]
            left = (part + room >= need[j]) & (part - room <= most[j])
            pairs, part = (i[left], j[left]), part[left]
        done = m
    return pairs


def products(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of integers."""
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), 1 << 16):
        out[k : k + (1 << 16)] = np.einsum("ij,ij->i", a[i[k : k + (1 << 16)]], b[j[k : k + (1 << 16)]])
    return out


class Best:
    """The first ``k`` (score descending, id ascending) of each slot, none below its floor."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor
        self.score, self.id = np.full((len(floor), k), NONE), np.full((len(floor), k), np.iinfo(np.int64).max)

    def need(self) -> np.ndarray:
        """The least score that may still enter, slot by slot."""
        return np.maximum(self.floor, self.score[:, -1])

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        last, own = self.score[slot, -1], self.id[slot, -1]
        good = (score >= self.floor[slot]) & ((score > last) | (score == last) & (ids < own))
        slot, score, ids = slot[good], score[good], ids[good]
        if not len(slot):
            return
        met = np.unique(slot)
        slot, score, ids = np.concatenate([np.repeat(met, self.k), slot]), np.concatenate([self.score[met].ravel(), score]), np.concatenate([self.id[met].ravel(), ids])
        order = np.lexsort((ids, -np.maximum(score, NONE + 1), slot))
        slot, score, ids = slot[order], score[order], ids[order]
        at = np.arange(len(slot)) - np.searchsorted(slot, slot)
        first = at < self.k
        self.score[slot[first], at[first]], self.id[slot[first], at[first]] = score[first], ids[first]

    def rows(self) -> pa.RecordBatch:
        slot, at = np.nonzero(self.score > NONE)
        return pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(self.id[slot, at]), pa.array(self.score[slot, at])], names=["slot", "id", "score"])


class Search:
    """The lists of a chunk of anchors. Slots are anchors for positives, and an anchor's bands (of low to high) for negatives."""

    def __init__(self, ids, labels, x, rotation, levels, k):
        self.ids, self.labels, self.anchors = ids, labels, Rotated(x, rotation, levels)
        self.rotation, self.levels, self.k = rotation, levels, k

    def tiles(self, stream):
        step = max(1, TILE // max(1, len(self.ids)))
        for batch in stream:
            x = matrix(batch.column(2), len(self.rotation))
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a in range(0, len(ids), step):
                yield ids[a : a + step], labels[a : a + step], Rotated(x[a : a + step], self.rotation, self.levels)

    def positives(self, stream, best: Best):
        """Partners of an anchor's label, label by label."""
        of = {int(v): np.nonzero(self.labels == v)[0] for v in np.unique(self.labels)}
        for ids, labels, rows in self.tiles(stream):
            for v in np.unique(labels):
                if (at := of.get(int(v))) is not None:
                    mine = np.nonzero(labels == v)[0]
                    i, j = survivors(rows.part(mine), self.anchors.part(at), self.levels, best.need()[at], np.full(len(at), np.inf))
                    i, j = mine[i], at[j]
                    other = ids[i] != self.ids[j]
                    i, j = i[other], j[other]
                    best.offer(j, products(rows.x, i, self.anchors.x, j), ids[i])
        yield best.rows()

    def negatives(self, stream, best: Best, low: np.ndarray, high: np.ndarray):
        """Partners of other labels within the bands; low, high: an anchor's bands, a band without scores where high is below low."""
        bands = low.shape[1]
        most = np.where(high >= low, high, NONE).max(1).astype(np.float64)
        for ids, labels, rows in self.tiles(stream):
            need = np.where(high >= low, best.need().reshape(low.shape), np.iinfo(np.int64).max).min(1)
            i, j = survivors(rows, self.anchors, self.levels, need, most, labels[:, None] != self.labels)
            other = ids[i] != self.ids[j]
            i, j = i[other], j[other]
            score = products(rows.x, i, self.anchors.x, j)
            for b in range(bands):
                within = (score >= low[j, b]) & (score <= high[j, b])
                best.offer(j[within] * bands + b, score[within], ids[i[within]])
        yield best.rows()

    def guaranteed(self, ids, labels, x, same: bool, low=None, high=None) -> np.ndarray:
        """What a list's last score is at least, slot by slot, by the rows of the sample alone."""
        rows, eps = Rotated(x, self.rotation, self.levels), slack(len(self.rotation))
        bands, out = 1 if same else low.shape[1], []
        for a in range(0, len(self.ids), 512):
            part = self.anchors.part(slice(a, a + 512))
            score, room = part.y @ rows.y.T, eps * np.outer(part.norm, rows.norm)
            fits = (self.ids[a : a + 512, None] != ids) & ((self.labels[a : a + 512, None] == labels) == same)
            for b in range(bands):
                sure = fits if same else fits & (score - room >= low[a : a + 512, b, None]) & (score + room <= high[a : a + 512, b, None])
                least = np.where(sure, score - room, -np.inf)
                out.append(np.partition(least, -self.k, 1)[:, -self.k] if least.shape[1] >= self.k else np.full(len(least), -np.inf))
        last = np.concatenate([np.stack(out[i : i + bands], 1).ravel() for i in range(0, len(out), bands)])
        return np.where(np.isfinite(last), np.floor(np.maximum(last, -(2.0**62))), float(NONE)).astype(np.int64)


def merged(lists: DataFrame, k: int) -> DataFrame:
    """slot, id, score, rank: the first k of each slot, of the lists of all tasks."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, *, key: str = "vec_id", label: str = "label", vector: str = "embedding", k: int = 5, low: int = 80, high: int = 100, chunk: int = CHUNK, sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first k rows of
    the same label, the first k rows of other labels with low % to high % of that row's score."""
    spark = rows.sparkSession
    bounded_batches(spark)
    ready = usable(rows, key, label, vector, anchors)
    size = ready.agg(F.max(F.size("x")).alias("dims"), F.count_if("anchor").alias("anchors"), F.count("*").alias("rows")).first()
    dims, chunks = max(1, size["dims"] or 1), -(-size["anchors"] // chunk)
    out = scratch(spark, "negatives")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not chunks:
        return spark.createDataFrame([], schema)
    known = sampled(ready.select("id", "label", "x"), sample, size["rows"], "id", "label", "x").limit(sample).toArrow()
    s_ids, s_labels, s_x = known["id"].to_numpy(), known["label"].to_numpy(), matrix(known["x"], dims)
    rotation, levels = learned(s_x)
    at = scratch(spark, "anchors")
    ready.where("anchor").select("id", "label", "x", F.pmod(F.monotonically_increasing_id(), F.lit(chunks)).alias("chunk")).write.parquet(at)
    every, lists = ready.select("id", "label", "x"), "slot int, id bigint, score bigint"
    for c in range(chunks):
        own = spark.read.parquet(at).where(F.col("chunk") == c).orderBy("id").toArrow()
        if not len(own):
            continue
        ids = own["id"].to_numpy()
        search = Search(ids, own["label"].to_numpy(), matrix(own["x"], dims), rotation, levels, k)
        best = Best(search.guaranteed(s_ids, s_labels, s_x, True), k)
        found = merged(every.mapInArrow(lambda stream, s=search, b=best: s.positives(stream, b), lists), k).toArrow()  # at most k rows an anchor
        slot, rank = found["slot"].to_numpy(), found["rank"].to_numpy() - 1
        upper = np.full((len(ids), k), -1, np.int64)
        upper[slot, rank] = found["score"].to_numpy()
        lower = np.where(upper >= 0, -(-low * upper // 100), 0)
        upper = np.where(upper >= 0, high * upper // 100, -1)
        best = Best(np.maximum(search.guaranteed(s_ids, s_labels, s_x, False, lower, upper), lower.ravel()), k)
        partners = merged(every.mapInArrow(lambda stream, s=search, b=best, lo=lower, hi=upper: s.negatives(stream, b, lo, hi), lists), k)
        positives = pa.table({"slot": pa.array((slot * k + rank).astype(np.int32)), "anchor_id": pa.array(ids[slot]), "positive_id": found["id"], "positive_score": found["score"]})
        both = partners.join(spark.createDataFrame(positives), "slot")  # at most k * chunk rows
        both.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{out}/chunk={c}")
    return spark.read.schema(schema).parquet(out).drop("chunk")

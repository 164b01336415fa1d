"""Exact nearest neighbours of all rows among all rows, for points of few dimensions.

Equal points are one spot with the first k + 1 keys of its rows, which is all that neighbours can be of them, however many rows a spot has.
Spots are dealt into cells of about equal size by a tree learned from a sample. A cell tells of each of its spots how far the k-th
neighbour is at most. Two cells meet only if the one's box reaches the other's within the farthest of these distances, and a spot
takes from another cell only what is within its own. Lists of k + 1 meet at the end. So work follows the rows where neighbours are near,
in any density; in many dimensions all boxes touch, and every cell would meet every other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .cells import Cells

#: Spots that cells are learned from (about as many), and spots of a cell.
SAMPLE, BLOCK = 1 << 16, 1024
#: Distances that are held at once.
TILE = 1 << 21


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, coordinate by coordinate, so that each is the same wherever it is taken."""
    out = np.zeros((len(a), len(b)))
    for c in range(a.shape[1]):
        out += (a[:, c, None] - b[:, c]) ** 2
    return out


def reach(x: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """For each spot the squared distance within which its cell has k rows besides itself; infinite if it has fewer."""
    out, step = np.full(len(x), np.inf), max(1, TILE // max(1, len(x)))
    if weights.sum() > k:
        for a in range(0, len(x), step):
            d = squares(x[a : a + step], x)
            order = np.argsort(d, axis=1, kind="stable")
            enough = np.cumsum(weights[order], axis=1) > k
            out[a : a + step] = np.take_along_axis(d, order, 1)[np.arange(len(d)), enough.argmax(1)]
    return out


def nearest_of_all(rows: DataFrame, key: str, columns: list[str], k: int = 5, *, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """query, key, distance, rank: the k nearest other rows (all, if fewer) of each row by Euclid's distance, ties by the smaller key.
    Keys differ; rows without a key, or with a coordinate that is null or not finite, take no part."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    numbers = [F.col(c).cast("double") for c in columns]
    fine = F.col(key).isNotNull()
    for v in numbers:
        fine = fine & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    points = rows.where(fine).select(F.col(key).alias("k"), F.array(*(v + 0.0 for v in numbers)).alias("x"))
    kind, width = dict(points.dtypes)["k"], len(columns)
    first = points.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy("k"))).where(F.col("r") <= k + 1)
    spots = checkpointed(first.groupBy("x").agg(F.array_sort(F.collect_list("k")).alias("keys")))
    total = spots.count()
    out = f"query {kind}, {key} {kind}, distance double, rank int"
    if not total:
        return spark.createDataFrame([], out)
    part = int(min(1.0, sample / total) * (1 << 31))
    few = spots.where(F.pmod(F.xxhash64("x"), F.lit(1 << 31)) <= part).select("x").limit(2 * sample).toArrow()
    coordinates = lambda column, n: column.flatten().to_numpy(zero_copy_only=False).reshape(n, width)
    tree = Cells(coordinates(few["x"].combine_chunks(), len(few)), min(max(1, len(few) // 4), -(-total // block)))

    def placed(stream):
        for batch in stream:
            cell = tree.of(coordinates(batch.column(0), batch.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), batch.column(1)], names=["cell", "x", "keys"])

    def told(stream):
        for batch in stream:
            for cell, of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, weights = np.array([r["x"] for r in of]), np.array([len(r["keys"]) for r in of])
                near = reach(x, weights, k)
                spot = [{"x": r["x"], "keys": r["keys"], "within": float(w)} for r, w in zip(of, near)]
                yield pa.RecordBatch.from_pylist([{"cell": cell, "low": x.min(0).tolist(), "high": x.max(0).tolist(), "most": float(near.max()), "spots": spot}], schema=batch_schema(batch))

    def batch_schema(batch):
        keys = batch.schema.field(1).type.value_type.field("keys").type
        numbers_ = pa.list_(pa.float64())
        spot = pa.struct([("x", numbers_), ("keys", keys), ("within", pa.float64())])
        return pa.schema([("cell", pa.int64()), ("low", numbers_), ("high", numbers_), ("most", pa.float64()), ("spots", pa.list_(spot))])

    held = spots.mapInArrow(placed, f"cell bigint, x array<double>, keys array<{kind}>").groupBy("cell").agg(F.collect_list(F.struct("x", "keys")).alias("of"))
    ready = checkpointed(held.mapInArrow(told, f"cell bigint, low array<double>, high array<double>, most double, spots array<struct<x:array<double>,keys:array<{kind}>,within:double>>"))
    boxes = ready.select("cell", "low", "high", "most").orderBy("cell").collect()  # a row a cell, of at most a quarter of the sample
    low, high, most = np.array([r["low"] for r in boxes]), np.array([r["high"] for r in boxes]), np.array([r["most"] for r in boxes])
    a, b = [], []
    for i in range(len(boxes)):
        gap = np.maximum(0, np.maximum(low[i] - high, low - high[i]))
        met = np.nonzero((gap**2).sum(1) * (1 - 1e-12) <= most[i])[0]
        a += [boxes[i]["cell"]] * len(met)
        b += [boxes[j]["cell"] for j in met]
    pairs = spark.createDataFrame(pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}))
    left, right = ready.select(F.col("cell").alias("a"), F.col("spots").alias("left")), ready.select(F.col("cell").alias("b"), F.col("spots").alias("right"))
    both = pairs.join(left, "a").join(right, "b").select("left", "right").repartition(F.rand(1))

    def searched(stream):
        for batch in stream:
            kind_of = batch.schema.field("left").type.value_type.field("keys").type.value_type
            for of, others in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = np.array([r["x"] for r in of]), np.array([r["x"] for r in others])
                within = np.array([r["within"] for r in of])
                found, step = [], max(1, TILE // len(y))
                for begin in range(0, len(x), step):
                    d = squares(x[begin : begin + step], y)
                    for i in np.nonzero((d <= within[begin : begin + step, None]).any(1))[0]:
                        close = np.nonzero(d[i] <= within[begin + i])[0]
                        if len(close) > k + 1:  # as each has a row at least, and ties count
                            close = close[d[i, close] <= np.partition(d[i, close], k)[k]]
                        best = sorted((d[i, j], other) for j in close for other in others[j]["keys"])[: k + 1]
                        found += [(of[begin + i]["keys"][0], other, v) for v, other in best]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], kind_of), pa.array([r[1] for r in found], kind_of), pa.array([r[2] for r in found], pa.float64())], names=["q", "other", "d"])

    found = both.mapInArrow(searched, f"q {kind}, other {kind}, d double")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "other"))).where(F.col("r") <= k + 1)
    lists = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("d", "other"))).alias("near"))
    of_row = points.join(spots.select("x", F.get("keys", F.lit(0)).alias("q")), "x").join(lists, "q")
    others = F.slice(F.filter("near", lambda c: c["other"] != F.col("k")), 1, k)
    return of_row.select(F.col("k").alias("query"), F.posexplode(others).alias("rank", "c")).select("query", F.col("c.other").alias(key), F.sqrt("c.d").alias("distance"), (F.col("rank") + 1).alias("rank"))

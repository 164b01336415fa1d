"""Running sums, ranks and exact quantiles that no single task has to order all rows, or all of a group, for.

Different values are counted first, which combines before it shuffles. The counts are cut into ranges of the group and the value, so that a
large group spans several, and written once; each range is ordered by itself, and the sums of the ranges before it in its group are
added. Only a group that goes on over the end of a range has such sums: two rows for each range at most, which are broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: The accuracy of approximate quantiles: their rank is off by a 10,000th of the rows at most.
ACCURACY = 10_000


def ranged(values: DataFrame, *keys: str) -> DataFrame:
    """The rows in ranges of the keys, whose number is ``_range``, written to the shared folder."""
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(values.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()))


def same(left: list[str], right: list[str]) -> Column:
    """Equality of columns in pairs, nulls being equal."""
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)))


def _elsewhere(held: DataFrame, by: list[str], totals: list[Column], sums: list[Column]) -> DataFrame:
    """A row for each range and group, named ``_of`` and ``_k...``, of groups that have several ranges: two rows a range at most."""
    every = Window.partitionBy(*(by or [F.lit(0)]))
    parts = held.groupBy("_range", *by).agg(*totals).withColumn("_spans", F.count("*").over(every))
    return parts.where("_spans > 1").select(F.col("_range").alias("_of"), *(F.col(b).alias(f"_k{i}") for i, b in enumerate(by)), *sums)


def running(values: DataFrame, value: str, sums: list[str], by: list[str] | None = None) -> DataFrame:
    """values: one row for each different value (of a group). Each of ``sums`` becomes its sum over all values (of the group) up to the
    row's own. Rows that ``ranged`` gave are taken as they are."""
    by = list(by or [])
    held = values if "_range" in values.columns else ranged(values, *by, value)
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offset = _elsewhere(held, by, [F.sum(s).alias(s) for s in sums], [F.sum(s).over(before).alias("_" + s) for s in sums])
    own = Window.partitionBy("_range", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    keys = [f"_k{i}" for i in range(len(by))]
    out = held.withColumns({s: F.sum(s).over(own) for s in sums}).join(F.broadcast(offset), same(["_range", *by], ["_of", *keys]), "left")
    return out.withColumns({s: F.col(s) + F.coalesce("_" + s, F.lit(0)) for s in sums}).drop("_range", "_of", *keys, *("_" + s for s in sums))


def least_from(values: DataFrame, value: str, column: str) -> DataFrame:
    """values: one row for each different value, as ``ranged`` gave them. ``column`` becomes its least over the row's own value and all
    higher ones."""
    after = Window.partitionBy(F.lit(0)).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    offset = _elsewhere(values, [], [F.min(column).alias("_low")], [F.min("_low").over(after).alias("_low")])
    own = Window.partitionBy("_range").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    out = values.withColumn(column, F.min(column).over(own)).join(F.broadcast(offset), F.col("_range") == F.col("_of"), "left")
    return out.withColumn(column, F.least(column, "_low")).drop("_range", "_of", "_low")


def group_quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """by, n, q: how many values a group has that are neither null nor NaN, and its exact quantiles, interpolated between neighbours.
    A group of all rows is ordered by as many tasks as any."""
    v = F.col(value).cast("double")
    counts = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, v.alias("_v")).agg(F.count("*").alias("_n"))
    upto = running(counts.withColumn("_upto", F.col("_n")), "_v", ["_upto"], by)
    upto = checkpointed(upto)
    sizes = upto.groupBy(*by).agg(F.sum("_n").alias("_size")).select("_size", *(F.col(b).alias(f"_k{i}") for i, b in enumerate(by)))
    rows = upto.join(sizes, same(by, [f"_k{i}" for i in range(len(by))])) if by else upto.crossJoin(F.broadcast(sizes))
    holds = lambda at: (F.col("_upto") > at) & (F.col("_upto") - F.col("_n") <= at)
    parts = []
    for i, p in enumerate(shares):
        at = p * (F.col("_size") - 1)
        low = F.floor(at + F.lit(0.0))
        high = F.least(low + 1, F.col("_size") - 1)
        parts += [F.max(F.when(holds(low), F.col("_v"))).alias(f"_a{i}"), F.max(F.when(holds(high), F.col("_v"))).alias(f"_b{i}"), F.max(at - low).alias(f"_w{i}")]
    found = rows.groupBy(*by).agg(F.max("_size").alias("n"), *parts)
    return found.select(*by, "n", F.array(*(F.col(f"_a{i}") + F.col(f"_w{i}") * (F.col(f"_b{i}") - F.col(f"_a{i}")) for i in range(len(shares)))).alias("q"))


def numbered(rows: DataFrame, by: str, number: str) -> DataFrame:
    """rows: ``by`` differs in each. Adds the place of ``by`` among them, from 1: ranges are numbered by themselves, after the counts
    of those before (a row a range)."""
    dealt = ranged(rows, by)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select(F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(by))
    return dealt.withColumn(number, own).join(F.broadcast(counts), F.col("_range") == F.col("_of")).withColumn(number, F.col(number) + F.col("_before")).drop("_range", "_of", "_before")


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of each column, interpolated between neighbours; nulls and NaN do not count.

    Approximate quantiles bracket each exact one; a second pass counts what lies below a bracket and groups the values inside, some
    2 / ACCURACY of the rows. Only the results reach the driver.
    """
    eps = 2 / ACCURACY
    bracket = [x for p in shares for x in (max(0.0, p - eps), min(1.0, p + eps))]
    number = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    first = df.agg(*(x for c in columns for x in (F.count(number[c]).alias(f"n_{c}"), F.percentile_approx(number[c], bracket, ACCURACY).alias(f"q_{c}")))).first()
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    known = [c for c in columns if first[f"n_{c}"]]
    if not known or not shares:
        return out
    parts, sides = [], []
    for c in known:
        v = number[c]
        for k in range(len(shares)):
            a, b = first[f"q_{c}"][2 * k : 2 * k + 2]
            parts.append(F.when(v.between(a, b), F.struct(F.lit(c).alias("c"), F.lit(k).alias("k"), v.alias("v"))))
            sides += [F.count_if(v < a).alias(f"below_{c}_{k}"), F.max(F.when(v < a, v)).alias(f"left_{c}_{k}"), F.min(F.when(v > b, v)).alias(f"right_{c}_{k}")]
    side = df.agg(*sides).first()
    inside = df.select(F.explode(F.array_compact(F.array(*parts))).alias("x")).groupBy("x").agg(F.count("*").alias("n")).select("x.*", "n")
    rows = []
    for c in known:
        for k, p in enumerate(shares):
            at = p * (first[f"n_{c}"] - 1)
            rows.append((c, k, int(at) - side[f"below_{c}_{k}"], min(int(at) + 1, first[f"n_{c}"] - 1) - side[f"below_{c}_{k}"]))
    wanted = df.sparkSession.createDataFrame(rows, "c string, k int, low bigint, high bigint")
    upto = F.sum("n").over(Window.partitionBy("c", "k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("upto", upto).join(F.broadcast(wanted), ["c", "k"]).groupBy("c", "k", "low", "high")
    found = found.agg(F.min(F.when(F.col("upto") > F.col("low"), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > F.col("high"), F.col("v"))).alias("b"))
    for r in found.collect():
        c, k = r["c"], r["k"]
        low = side[f"left_{c}_{k}"] if r["low"] < 0 else r["a"] if r["a"] is not None else side[f"right_{c}_{k}"]
        high = side[f"left_{c}_{k}"] if r["high"] < 0 else r["b"] if r["b"] is not None else side[f"right_{c}_{k}"]
        at = shares[k] * (first[f"n_{c}"] - 1)
        out[c][k] = low + (at - int(at)) * (high - low)
    return out

"""Descriptive aggregates, contingency tables and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import group_quantiles, quantiles, same


def describe(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """n, mean, population and sample deviation, quartiles, extremes, biased skewness and excess kurtosis of each column, one
    row for each (group and) column."""
    if not by:
        return _described(df, columns)
    long = df.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select(*by, "x.feature", "x.v").where("v is not null and not isnan(v)")
    stats = long.groupBy(*by, "feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std_pop"), F.stddev_samp("v").alias("std_samp"), F.min("v").alias("min"), F.max("v").alias("max"), F.skewness("v").alias("skewness"), F.kurtosis("v").alias("kurtosis"))
    keys = [f"_by{i}" for i in range(len(by) + 1)]
    q = group_quantiles(long, [*by, "feature"], "v", [0.25, 0.5, 0.75]).select("n", "q", *(F.col(b).alias(k) for b, k in zip([*by, "feature"], keys, strict=True)))
    out = stats.join(q, same([*by, "feature"], keys)).drop(*keys)
    return out.withColumns({"q1": F.get("q", F.lit(0)), "median": F.get("q", F.lit(1)), "q3": F.get("q", F.lit(2))}).drop("q")


def _described(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same over all rows: moments in one pass, quartiles by ``order.quantiles``."""
    q, v = quantiles(df, columns, [0.25, 0.5, 0.75]), {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    stats = {"n": F.count, "mean": F.avg, "std_pop": F.stddev_pop, "std_samp": F.stddev_samp, "min": F.min, "max": F.max, "skewness": F.skewness, "kurtosis": F.kurtosis}
    one = df.agg(*(f(v[c]).alias(f"{c}_{name}") for c in columns for name, f in stats.items()))
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), *(F.col(f"`{c}_{name}`").alias(name) for name in stats), *(F.lit(x).cast("double").alias(name) for name, x in zip(("q1", "median", "q3"), q[c], strict=True))) for c in columns))
    return one.select(F.explode(rows).alias("x")).select("x.*").where("n > 0")


def level_shares(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """Counts and percentages of listed levels, in their order, those without rows included; other values count in the total."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("level")).agg(F.count("*").alias("n"))
    listed = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(levels)], "level string, pos int")
    total = counts.agg(F.sum("n").alias("total"))
    out = listed.join(counts, "level", "left").crossJoin(F.broadcast(total))
    return out.select("pos", "level", F.coalesce("n", F.lit(0)).alias("n"), (100.0 * F.coalesce("n", F.lit(0)) / F.col("total")).alias("pct"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share"))


def crosstab(df: DataFrame, row: str, col: str) -> DataFrame:
    """Long contingency table; null keys are dropped."""
    return df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(F.col(row).alias("r"), F.col(col).alias("c")).agg(F.count("*").alias("n"))


def crosstab_margins(df: DataFrame, row: str, col: str) -> DataFrame:
    """With totals labelled All, by a cube."""
    both = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).select(F.col(row).alias("r"), F.col(col).alias("c"))
    out = both.cube("r", "c").agg(F.count("*").alias("n"), F.grouping("r").alias("_gr"), F.grouping("c").alias("_gc"))
    return out.select(F.when(F.col("_gr") == 1, "All").otherwise(F.col("r")).alias("r"), F.when(F.col("_gc") == 1, "All").otherwise(F.col("c")).alias("c"), "n")


def crosstab_shares(df: DataFrame, row: str, col: str) -> DataFrame:
    return crosstab(df, row, col).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("r")))


def mode_of(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """The commonest value of each group, the least of equals."""
    return df.where(F.col(column).isNotNull()).groupBy(*by).agg(F.mode(column, True).alias("mode"))


def group_profile(df: DataFrame, by: str, first: str, order: str, column: str) -> DataFrame:
    """First value by an order, mode, rows and different values."""
    return df.groupBy(by).agg(F.min_by(first, order).alias("first"), F.mode(column, True).alias("mode"), F.count("*").alias("n"), F.count_distinct(column).alias("kinds"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal bins, empty ones included, the last with its upper edge."""
    inside = df.where(F.col(column).between(low, high))
    at = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def top_groups(df: DataFrame, by: str, value: str, k: int) -> DataFrame:
    return df.groupBy(by).agg(F.max(value).alias("top")).orderBy(F.desc("top"), by).limit(k)


def vector_summary(df: DataFrame, by: str, parts: list[str]) -> DataFrame:
    """n, mean, sample deviation and quartiles of each component, long."""
    return describe(df, parts, [by]).select(by, F.col("feature").alias("component"), "n", "mean", F.col("std_samp").alias("std"), "q1", "median", "q3")


def normalised(df: DataFrame, column: str, by: str) -> DataFrame:
    """Median of a group's values on a scale from the 2nd to the 98th percentile of all."""
    low, high = (F.lit(x) for x in quantiles(df, [column], [0.02, 0.98])[column])
    scaled = df.withColumn("_s", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col(column) - low, high - low))))
    return scaled.groupBy(by).agg(F.percentile("_s", 0.5).alias("median"))


def wide_summary(df: DataFrame, by: str, feature: str, mode: str, modes: list[str]) -> DataFrame:
    """{feature}_{mode}_{stat} columns out of a long table of feature, mode, value."""
    stats = df.groupBy(by, feature).pivot(mode, modes).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return stats


def relative_error(std, original):
    return F.when(F.abs(original) > 1e-10, 100 * std / F.abs(original))


def unanimous(df: DataFrame, by: str, column: str) -> DataFrame:
    return df.groupBy(by).agg((F.count_distinct(column) == 1).alias("same"))


def outer_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """added, removed or changed keys of two versions."""
    both = a.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a")).join(b.select(key, F.col(value).alias("_b"), F.lit(True).alias("_in_b")), key, "full")
    status = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(key, status.alias("status")).where("status is not null")


def first_of(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group by a total order, as an aggregate that combines before it shuffles."""
    kept = df.groupBy(*by).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_r"))
    return kept.select("_r.*")


def pivot_first(df: DataFrame, keys: list[str], column: str, value: str, order: list[str], levels: list[str]) -> DataFrame:
    """A row for each of the keys, a column for each listed level: the value of the first row of that level in ``order``, nulls last."""
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(*keys).pivot(column, levels).agg(F.min_by(value, F.struct(*order)))

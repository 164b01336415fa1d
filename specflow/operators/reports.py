"""Reports as rows: of clusters, of precision under resampling, of extracted texts, of a table's statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count
from .order import group_quantiles, same
from .statistics import correlations
from .summaries import describe


def clustering_report(df: DataFrame, label: str, features: list[str], noise: int = -1) -> DataFrame:
    """cluster, feature, n, mean, std (population), min, max, median, share: a row for each cluster and feature, ``noise`` a cluster like any
    other; and how many rows, clusters and rows of noise there are, in rows without a cluster: feature tells which."""
    each = describe(df.where(F.col(label).isNotNull()), features, [label]).select(F.col(label).cast("string").alias("cluster"), "feature", "n", "mean", F.col("std_pop").alias("std"), "min", "max", "median")
    sizes = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("g")).agg(F.count("*").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_samples"), F.count_if(F.col("g") != noise).alias("n_clusters"), F.coalesce(F.sum(F.when(F.col("g") == noise, F.col("n"))), F.lit(0)).alias("n_noise"))
    share = {"n_noise": F.try_divide(F.col("n_noise").cast("double"), F.col("n_samples"))}
    facts = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("n"), share.get(c, F.lit(None).cast("double")).alias("share")) for c in ("n_samples", "n_clusters", "n_noise")))
    return each.unionByName(total.select(F.explode(facts).alias("x")).select("x.*"), allowMissingColumns=True)


def precision_report(df: DataFrame, by: list[str], cv: str) -> DataFrame:
    """by, n, median_cv, mean_cv, p90_cv, and the percentages of variation below 5 and 10 %."""
    v = F.col(cv).cast("double")
    known = df.where(v.isNotNull() & ~F.isnan(v))
    q = group_quantiles(known, by, cv, [0.5, 0.9]).select("q", *(F.col(b).alias(f"_k{i}") for i, b in enumerate(by)))
    means = known.groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean_cv"), (100 * F.avg((v < 0.05).cast("double"))).alias("pct_below_5"), (100 * F.avg((v < 0.10).cast("double"))).alias("pct_below_10"))
    out = means.join(q, same(by, [f"_k{i}" for i in range(len(by))]))
    return out.select(*by, "n", F.get("q", F.lit(0)).alias("median_cv"), "mean_cv", F.get("q", F.lit(1)).alias("p90_cv"), "pct_below_5", "pct_below_10")


def extraction_report(articles: DataFrame, raw: Column, trimmed: Column, confidence: Column) -> DataFrame:
    """One row: articles, words before and after trimming, words saved, and articles that must be entered by hand (confidence low or none)."""
    a, b = (F.coalesce(word_count(t), F.lit(0)) for t in (raw, trimmed))
    one = articles.agg(F.count("*").alias("n_articles"), F.coalesce(F.sum(a), F.lit(0)).alias("total_words_raw"), F.coalesce(F.sum(b), F.lit(0)).alias("total_words_trimmed"), F.count_if(confidence.isin("none", "low")).alias("manual_entry"))
    return one.withColumn("words_saved_by_trimming", F.col("total_words_raw") - F.col("total_words_trimmed"))


def statistics_report(df: DataFrame, columns: list[str], confidence: dict[str, Column]) -> DataFrame:
    """section, name, stat, value: what describes each column, the correlation of each pair, and how many rows have each confidence."""
    stats = ["mean", "std_pop", "median", "q1", "q3", "min", "max", "skewness", "kurtosis"]
    described = describe(df, columns).select(F.lit("descriptive").alias("section"), F.col("feature").alias("name"), F.explode(F.array(*(F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value")) for s in ["n", *stats]))).alias("x")).select("section", "name", "x.*")
    pairs = correlations(df, columns).select(F.lit("correlation").alias("section"), F.concat_ws("|", "a", "b").alias("name"), F.lit("pearson").alias("stat"), F.col("r").alias("value"))
    levels = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), c.alias("stat")) for k, c in confidence.items()))).alias("x")).select("x.*").groupBy("name", "stat").agg(F.count("*").cast("double").alias("value"))
    return described.unionByName(pairs).unionByName(levels.select(F.lit("confidence").alias("section"), "name", "stat", "value"))

"""Reference to modified pairs within a group, and what they show."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(samples: DataFrame, synthesis: DataFrame) -> DataFrame:
    """Left join on article and the sample's name but for case and space; right columns that clash get _syn."""
    right = synthesis.select(*(F.col(c).alias(c + "_syn" if c in samples.columns and c not in ("article_num",) else c) for c in synthesis.columns)).withColumnRenamed("article_num", "_article")
    return samples.join(right, (F.col("article_num") == F.col("_article")) & (F.lower(F.trim("sample")) == F.lower(F.trim("file_match"))), "left").drop("_article")


def merged_exact(samples: DataFrame, synthesis: DataFrame) -> DataFrame:
    """As above by the exact name."""
    right = synthesis.where("file_match is not null").select(*(F.col(c).alias(c + "_syn" if c in samples.columns and c != "article_num" else c) for c in synthesis.columns)).withColumnRenamed("article_num", "_article")
    return samples.join(right, (F.col("article_num") == F.col("_article")) & (F.col("sample") == F.col("file_match")), "left").drop("_article")


def primary_references(refs: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Of each group the row of least value, nulls last, then by order."""
    kept = refs.groupBy(group).agg(F.min_by(F.struct(*refs.columns), F.struct(F.col(value).isNull(), F.col(value), F.col(order))).alias("_r"))
    return kept.select("_r.*")


def virtual_references(rows: DataFrame, refs: DataFrame, group: str, means: list[str], modes: list[str]) -> DataFrame:
    """For groups without a reference: means and commonest values of their rows."""
    lone = rows.join(refs.select(group).distinct(), group, "left_anti")
    return lone.groupBy(group).agg(*(F.avg(c).alias(c) for c in means), *(F.mode(c, True).alias(c) for c in modes))


def pairs(rows: DataFrame, *, group: str, kind: str, value: str, order: str, measures: list[str], tags: list[str], reference: str = "reference", modified: str = "modified") -> DataFrame:
    """One row for each modified row with its group's reference, real or virtual: ref_, mod_ and d columns, and which tags
    changed. A group may hold any share of the rows: references are one row a group, joined."""
    refs, mods = rows.where(F.col(kind) == reference), rows.where(F.col(kind) == modified)
    real = primary_references(refs, group, value, order).select(group, *(F.col(c).alias("ref_" + c) for c in [order, *measures, *tags]), F.lit(False).alias("virtual_ref"))
    made = virtual_references(mods, refs, group, measures, tags).select(group, F.lit(None).cast(dict(rows.dtypes)[order]).alias("ref_" + order), *(F.col(c).alias("ref_" + c) for c in [*measures, *tags]), F.lit(True).alias("virtual_ref"))
    out = mods.select(group, *(F.col(c).alias("mod_" + c) for c in [order, *measures, *tags])).join(real.unionByName(made), group, "left")
    out = out.withColumns({"d_" + c: F.col("mod_" + c) - F.col("ref_" + c) for c in measures})
    return out.withColumns({c + "_changed": ~F.col("mod_" + c).eqNullSafe(F.col("ref_" + c)) for c in tags})


def classified(trans: DataFrame, first: str, second: str, third: str, thresholds: dict[str, float]) -> DataFrame:
    """Types of changes. z scores by the sample deviation of all, magnitude, net and purity of the pair, its angle; a change
    within both thresholds is perturbative, else its net says disordering or ordering; third: narrowing, widening, stable."""
    spread = trans.agg(F.stddev_samp(first).alias("_s1"), F.stddev_samp(second).alias("_s2"))
    out = trans.crossJoin(F.broadcast(spread)).withColumn("z1", F.try_divide(first, "_s1")).withColumn("z2", F.try_divide(second, "_s2"))
    out = out.withColumn("magnitude", F.sqrt(F.col("z1") * F.col("z1") + F.col("z2") * F.col("z2"))).withColumn("net", (F.col("z1") + F.col("z2")) / F.sqrt(F.lit(2.0)))
    out = out.withColumn("purity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.abs("net"), F.col("magnitude"))))).withColumn("angle", F.degrees(F.atan2("z2", "z1")))
    small = (F.abs(first) <= thresholds[first]) & (F.abs(second) <= thresholds[second])
    out = out.withColumn("tr_type", F.when(small, "perturbative").when(F.col("net") > 0, "disordering").otherwise("ordering"))
    t = thresholds[third]
    return out.withColumn("shift", F.when(F.col(third) < -t, "narrowing").when(F.col(third) > t, "widening").otherwise("stable")).drop("_s1", "_s2")


def noise_thresholds(bootstrap: DataFrame, factor: float = 2.0) -> dict[str, float]:
    """factor x median deviation x sqrt(2), for differences of two measurements."""
    r = bootstrap.agg(*(F.percentile(c, 0.5).alias(c) for c in ("E_u_meV_noise_std", "A_sub_noise_std", "E_g_eV_noise_std"))).first()
    return {d: factor * (r[c] or 0.0) * 2**0.5 for d, c in (("d_E_u_meV", "E_u_meV_noise_std"), ("d_A_sub", "A_sub_noise_std"), ("d_E_g_eV", "E_g_eV_noise_std"))}


def article_votes(trans: DataFrame, group: str, tag: str, order: str) -> DataFrame:
    """One row for each group: its first and commonest value, rows, different values."""
    return trans.groupBy(group).agg(F.min_by(tag, order).alias("first"), F.mode(tag, True).alias("mode"), F.count("*").alias("n"), F.count_distinct(tag).alias("kinds"))


def top_rows(df: DataFrame, by: str, value: str, key: str, k: int) -> DataFrame:
    """Top k rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(value), key))).where(F.col("_r") <= k).drop("_r")


def tag_changes(trans: DataFrame, group: str, tags: list[str], order: str) -> DataFrame:
    """group, tag, ref (of the first pair by an order), mods (the different values of its modified rows, sorted, joined) and changed,
    whether any of them is not ref: one row for each group and tag."""
    rows = trans.select(group, F.col(order).alias("_o"), F.explode(F.array(*(F.struct(F.lit(t).alias("tag"), F.col("ref_" + t).cast("string").alias("ref"), F.col("mod_" + t).cast("string").alias("mod")) for t in tags))).alias("x")).select(group, "_o", "x.*")
    named = F.coalesce("mod", F.lit("unknown"))
    by = rows.groupBy(group, "tag").agg(F.min_by("ref", "_o").alias("ref"), F.collect_set(named).alias("_mods"), F.array_join(F.sort_array(F.collect_set(named)), ", ").alias("mods"))
    return by.withColumn("changed", F.exists("_mods", lambda m: m != F.coalesce("ref", F.lit("unknown")))).drop("_mods")

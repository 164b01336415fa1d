"""Queries of smoothing, neighbours and cluster quality over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import convert
from ..operators import answers, curves, neighbours, reports, statistics, summaries, tags, titles
from ..session import shared_dir
from .queries import POINTS, points, query, table


def _smoothing(window: int) -> str:
    """Least squares over the window around each point, moved inside at the ends, from its sums of y, t y and t t y."""
    m = window // 2
    n, s2, s4 = window, sum(t * t for t in range(-m, m + 1)), sum(t**4 for t in range(-m, m + 1))
    return f"""SELECT user_id, event_id, CASE WHEN n < {n} THEN value ELSE (s0 - {s2} * b2) / {n} + b1 * t + b2 * t * t END AS v FROM (
 SELECT *, s1 / {s2} AS b1, ({n} * s2 - {s2} * s0) / {n * s4 - s2 * s2} AS b2 FROM (
 SELECT a.user_id, a.event_id, a.value, a.n, a.pos - a.c AS t, sum(b.value) AS s0, sum((b.pos - a.c) * b.value) AS s1, sum((b.pos - a.c) * (b.pos - a.c) * b.value) AS s2
 FROM (SELECT *, greatest(least(pos, n - {m}), {m} + 1) AS c FROM p) a JOIN p b ON a.user_id = b.user_id AND abs(b.pos - a.c) <= {m} GROUP BY ALL))"""


@query(
    f"""WITH p AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM ({POINTS})), a AS ({_smoothing(7)}), b AS ({_smoothing(11)})
SELECT a.user_id, a.event_id, round(a.v, 6) AS seven, round(b.v, 6) AS eleven FROM a JOIN b ON a.user_id = b.user_id AND a.event_id = b.event_id"""
)
def smoothed_curves(spark, sf_dir):
    p = points(spark, sf_dir)
    for name, window in (("seven", 7), ("eleven", 11)):
        p = curves.smoothed(p, "user_id", ["event_id"], "value", name, window)
    return p.select("user_id", "event_id", F.round("seven", 6).alias("seven"), F.round("eleven", 6).alias("eleven"))


@query(
    """SELECT a AS query, b AS p_partkey, round(d, 6) AS distance, CAST(k AS INTEGER) AS rank FROM (SELECT a.p_partkey AS a, b.p_partkey AS b, sqrt(pow(a.p_size - b.p_size, 2) + pow(a.p_retailprice - b.p_retailprice, 2)) AS d,
 row_number() OVER (PARTITION BY a.p_partkey ORDER BY pow(a.p_size - b.p_size, 2) + pow(a.p_retailprice - b.p_retailprice, 2), b.p_partkey) AS k FROM part a JOIN part b ON a.p_partkey <> b.p_partkey) WHERE k <= 5"""
)
def nearest_of_all(spark, sf_dir):
    found = neighbours.nearest_of_all(table(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice"])
    return found.withColumn("distance", F.round("distance", 6))


@query(
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), d AS (SELECT a.vec_id AS i, a.label AS g, b.label AS h, sum(pow(list_distance(a.x, b.x), 2)) AS s, count(*) AS n FROM v a JOIN v b ON true GROUP BY ALL),
e AS (SELECT i, max(CASE WHEN g = h THEN CASE WHEN n > 1 THEN s / (n - 1) END END) AS own, min(CASE WHEN g <> h THEN s / n END) AS other FROM d GROUP BY i)
SELECT round(avg(CASE WHEN own IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END), 6) AS silhouette FROM e"""
)
def squared_silhouette(spark, sf_dir):
    return statistics.squared_silhouette(table(spark, sf_dir, "embeddings"), "embedding", "label", 64).select(F.round("silhouette", 6).alias("silhouette"))


@query(
    """WITH v AS (SELECT label, vec_id, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM v GROUP BY ALL),
d AS (SELECT label, avg(d) AS d FROM (SELECT label, vec_id, sqrt(sum(pow(x - m, 2))) AS d FROM v JOIN c USING (label, i) GROUP BY ALL) GROUP BY label),
g AS (SELECT a.label AS a, b.label AS b, sqrt(sum(pow(a.m - b.m, 2))) AS g FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY ALL)
SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT a, max((x.d + y.d) / g) AS r FROM g JOIN d x ON x.label = a JOIN d y ON y.label = b GROUP BY a)"""
)
def davies_bouldin(spark, sf_dir):
    return statistics.davies_bouldin(table(spark, sf_dir, "embeddings"), "embedding", "label", 64).select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


def recorded():
    """A client that has an answer to every prompt, from the prompt itself: a family, and a duration that may be none that is allowed."""
    import json

    return lambda prompt: json.dumps({"samples": [{"precursor_family": prompt.split("#")[-1], "duration_bin": "GT8H " if int(prompt.split("#")[1]) % 2 else "long"}], "drs_instrument": "d", "general_notes": prompt[:8]})


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS article_id, 'success' AS extraction_status, CASE c_custkey % 3 WHEN 0 THEN 'urea' WHEN 1 THEN 'melamine' ELSE 'other' END AS precursor_family,
 CASE WHEN c_custkey % 2 = 1 THEN 'gt8h' ELSE '2_4h' END AS duration_bin, 'other' AS synthesis_method, 'none' AS dopant_class FROM customer"""
)
def answered_articles(spark, sf_dir):
    family = F.element_at(F.array(F.lit("Urea"), F.lit("melamine"), F.lit("?")), (F.col("c_custkey") % 3 + 1).cast("int"))
    articles = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("article_id"), F.concat(F.col("c_name"), F.lit("#"), F.col("c_custkey"), F.lit("#"), family).alias("prompt"))
    at = f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}"
    found = answers.answer(articles, recorded, "prompt", at, version="v1_flat", batch=20_000, tasks=8, pause=0.0)
    rows = tags.flattened(found.select("article_id", "response"), "samples array<struct<precursor_family:string,duration_bin:string>>, drs_instrument string, general_notes string")
    return tags.all_validated(rows, "v1_flat").select("article_id", "extraction_status", "precursor_family", "duration_bin", "synthesis_method", "dopant_class")


RUNS = f"""SELECT a.user_id, a.pos AS x_i, b.pos AS x_j, count(*) AS n, regr_slope(c.value, c.pos) AS slope, regr_intercept(c.value, c.pos) AS intercept, regr_r2(c.value, c.pos) AS r2, var_pop(c.value) AS vy, var_pop(c.pos) AS vx
 FROM p a JOIN p b ON a.user_id = b.user_id AND b.pos - a.pos BETWEEN 5 AND 9 JOIN p c ON c.user_id = a.user_id AND c.pos BETWEEN a.pos AND b.pos GROUP BY a.user_id, a.pos, b.pos"""
SCORED = f"""SELECT *, 1000 / slope AS width, r2 - 0.15 * sqrt(greatest(0, (1 - r2) * vy / vx / (n - 2))) / slope AS score FROM ({RUNS}) WHERE slope > 0 AND r2 >= 0.6 AND 1000 / slope BETWEEN 15 AND 8000"""


@query(f"WITH p AS ({POINTS}) SELECT user_id, CAST(x_i AS BIGINT) AS i, CAST(x_j AS BIGINT) AS j, n, round(slope, 6) AS slope, round(intercept, 5) AS intercept, round(CASE WHEN vy = 0 THEN 0 ELSE r2 END, 6) AS r2 FROM ({RUNS})")
def straight_runs(spark, sf_dir):
    runs = curves.run_fits(points(spark, sf_dir), "user_id", "pos", "value", narrow=5.0, wide=9.0)
    return runs.select("user_id", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "n", F.round("slope", 6).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("r2", 6).alias("r2"))


@query(
    f"""WITH p AS ({POINTS}), s AS ({SCORED}), c AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY user_id) AS best FROM s) WHERE score >= best - 0.05),
m AS (SELECT user_id, median(width) AS m, count(*) AS runs FROM c GROUP BY user_id)
SELECT user_id, round(m, 4) AS width, round(r2, 6) AS r2, round(slope, 6) AS slope, runs FROM (SELECT c.*, m, runs, row_number() OVER (PARTITION BY c.user_id ORDER BY round(abs(width - m), 6), round(-score, 9), x_i, x_j) AS k FROM c JOIN m ON c.user_id = m.user_id) WHERE k = 1"""
)
def tails_of_runs(spark, sf_dir):
    runs = curves.run_fits(points(spark, sf_dir), "user_id", "pos", "value", narrow=5.0, wide=9.0)
    found = curves.tail_of_runs(runs, "user_id", least_r2=0.6, widest=8000.0, near=0.05)
    return found.select("user_id", F.round("width", 4).alias("width"), F.round("r2", 6).alias("r2"), F.round("slope", 6).alias("slope"), "runs")


@query()
def legacy_gaps(spark, sf_dir):
    """A user's events, summed up in their order, are the curve."""
    by = Window.partitionBy("user_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    p = points(spark, sf_dir).select("user_id", (1.5 + 0.05 * F.col("pos")).alias("energy"), F.sum("value").over(by).alias("tauc"))
    return curves.legacy_gaps(p, "user_id", "energy", "tauc").withColumns({c: F.round(c, 6) for c in ("gap", "r2", "slope", "intercept", "x_i", "x_j")})


@query(
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity > 0 AND l_tax > 0 THEN ln(l_tax) END, 9) AS of_absorbance, round(CASE WHEN l_quantity > 0 AND l_discount > 0 THEN ln(l_discount) / 0.5 - ln(l_quantity) END, 9) AS of_tauc,
 round(sqrt(l_discount * l_discount + l_tax * l_tax), 9) AS magnitude FROM lineitem"""
)
def log_absorption(spark, sf_dir):
    e, a, t = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    made = {"of_absorbance": convert.log_absorption(e, a), "of_tauc": convert.log_absorption_of_tauc(e, t, 0.5), "magnitude": convert.magnitude(t, a)}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(c, 9).alias(n) for n, c in made.items()))


@query(
    """WITH v AS (SELECT l_linenumber - 2 AS g, unnest(['l_quantity', 'l_discount']) AS feature, unnest([l_quantity, l_discount]) AS x FROM lineitem)
SELECT CAST(g AS VARCHAR) AS cluster, feature, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS min, max(x) AS max, median(x) AS median, NULL::DOUBLE AS share FROM v GROUP BY ALL
UNION ALL SELECT NULL, unnest(['n_samples', 'n_clusters', 'n_noise']), unnest([count(*), count(DISTINCT g) FILTER (g <> -1), count(*) FILTER (g = -1)]), NULL, NULL, NULL, NULL, NULL, unnest([NULL, NULL, round(count(*) FILTER (g = -1) / count(*), 9)]) FROM (SELECT l_linenumber - 2 AS g FROM lineitem)"""
)
def clustering_report(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("g", F.col("l_linenumber") - 2)
    found = reports.clustering_report(rows, "g", ["l_quantity", "l_discount"])
    return found.withColumns({c: F.round(c, n) for c, n in (("mean", 6), ("std", 6), ("share", 9))})


@query(
    """SELECT event_type, user_id % 3 AS part, count(*) AS n, round(median(v), 9) AS median_cv, round(avg(v), 9) AS mean_cv, round(quantile_cont(v, 0.9), 9) AS p90_cv, round(100 * avg((v < 0.05)::INT), 6) AS pct_below_5, round(100 * avg((v < 0.1)::INT), 6) AS pct_below_10
 FROM (SELECT *, value / 100 AS v FROM events WHERE value IS NOT NULL) GROUP BY ALL"""
)
def precision_report(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 3).alias("part"), (F.col("value") / 100).alias("v"))
    found = reports.precision_report(rows, ["event_type", "part"], "v")
    return found.withColumns({c: F.round(c, n) for c, n in (("median_cv", 9), ("mean_cv", 9), ("p90_cv", 9), ("pct_below_5", 6), ("pct_below_10", 6))})


WORDS = "CASE WHEN trim(regexp_replace({0}, '[ \\n\\t]+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace({0}, '[ \\n\\t]+', ' ', 'g')), ' ')) END"
PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '&#x[0-9a-f]+;|&[a-z]+;', '', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    f"""SELECT count(*) AS n_articles, CAST(sum(a) AS BIGINT) AS total_words_raw, CAST(sum(b) AS BIGINT) AS total_words_trimmed, count(*) FILTER (c IN ('none', 'low')) AS manual_entry, CAST(sum(a) - sum(b) AS BIGINT) AS words_saved_by_trimming
 FROM (SELECT coalesce({WORDS.format('text')}, 0) AS a, coalesce({WORDS.format('p')}, 0) AS b, CASE WHEN coalesce(length(text), 0) < 300 THEN 'low' ELSE 'high' END AS c FROM (SELECT text, {PLAIN} AS p FROM documents))"""
)
def extraction_report(spark, sf_dir):
    t = F.col("text")
    confidence = F.when(F.coalesce(F.length(t), F.lit(0)) < 300, "low").otherwise("high")
    return reports.extraction_report(table(spark, sf_dir, "documents"), t, titles.normalise(t), confidence)


@query(
    """WITH v AS (SELECT unnest(['o_totalprice', 'o_orderkey']) AS name, unnest([o_totalprice, o_orderkey::DOUBLE]) AS x FROM orders)
SELECT 'descriptive' AS section, name, unnest(['n', 'mean', 'std_pop', 'median', 'q1', 'q3', 'min', 'max']) AS stat, unnest([count(*), round(avg(x), 4), round(stddev_pop(x), 4), median(x), quantile_cont(x, 0.25), quantile_cont(x, 0.75), min(x), max(x)]) AS value FROM v GROUP BY name
UNION ALL SELECT 'correlation', 'o_totalprice|o_orderkey', 'pearson', round(corr(o_totalprice, o_orderkey), 4) FROM orders
UNION ALL SELECT 'confidence', 'priority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority"""
)
def statistics_report(spark, sf_dir):
    found = reports.statistics_report(table(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"], {"priority": F.col("o_orderpriority")})
    return found.where("stat not in ('skewness', 'kurtosis')").withColumn("value", F.round("value", 4))


@query(
    "SELECT user_id, " + ", ".join(f"arg_min(value, event_id) FILTER (event_type = '{t}') AS {t}" for t in ("click", "purchase", "view")) + " FROM events WHERE value IS NOT NULL GROUP BY user_id"
)
def pivot_first(spark, sf_dir):
    return summaries.pivot_first(table(spark, sf_dir, "events"), ["user_id"], "event_type", "value", ["event_id"], ["click", "purchase", "view"])

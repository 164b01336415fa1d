"""Registered queries of the curve engine, with the SQL that an independent engine can check them by.

The driver's tables hold no curves. A user's events stand for a curve (position, value), a customer's orders for the samples
of an article (status F is the reference), parts and line items for tagged samples, embeddings for feature vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import curves, statistics, summaries, tags, titles, transitions

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, pos, value: a user's events in order."""
    events = table(spark, sf_dir, "events").where("value is not null").select("user_id", "event_id", "value")
    return events.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("double"))


POINTS = "SELECT user_id, event_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS DOUBLE) AS pos FROM events WHERE value IS NOT NULL"
FITS = f"""SELECT user_id, CAST(pos AS BIGINT) AS start, CASE WHEN var_pop(value) OVER w = 0 THEN 0.0 ELSE regr_r2(value, pos) OVER w END AS r2, regr_slope(value, pos) OVER w AS slope,
 regr_intercept(value, pos) OVER w AS intercept, count(*) OVER w AS n FROM ({POINTS}) WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)"""


@query(f"SELECT user_id, start, round(r2, 6) AS r2, round(slope, 6) AS slope, round(intercept, 5) AS intercept FROM ({FITS}) WHERE n = 10")
def sliding_fit(spark, sf_dir):
    out = curves.sliding_fits(points(spark, sf_dir), "user_id", ["pos"], "pos", "value", 10)
    return out.select("user_id", F.col("start").cast("bigint").alias("start"), F.round("r2", 6).alias("r2"), F.round("slope", 6).alias("slope"), F.round("intercept", 5).alias("intercept"))


@query(
    f"""SELECT user_id, start, round(r2, 6) AS r2, round(slope, 6) AS slope, round(-intercept / slope, 4) AS crossing,
 CASE WHEN r2 >= 0.5 THEN 'high' WHEN r2 >= 0.3 THEN 'medium' ELSE 'low' END AS confidence
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(r2, 9) DESC, start) AS k FROM ({FITS}) WHERE n = 10 AND slope > 0.1) WHERE k = 1"""
)
def best_window(spark, sf_dir):
    best = curves.best_window(curves.sliding_fits(points(spark, sf_dir), "user_id", ["pos"], "pos", "value", 10), "user_id")
    label = F.when(F.col("r2") >= 0.5, "high").when(F.col("r2") >= 0.3, "medium").otherwise("low")
    return best.select("user_id", F.col("start").cast("bigint").alias("start"), F.round("r2", 6).alias("r2"), F.round("slope", 6).alias("slope"), F.round(-F.col("intercept") / F.col("slope"), 4).alias("crossing"), label.alias("confidence"))


@query(f"SELECT user_id, round(coalesce(sum(a), 0), 4) AS area FROM (SELECT user_id, (lead(pos) OVER w - pos) * (lead(value) OVER w + value) / 2 AS a FROM ({POINTS}) WINDOW w AS (PARTITION BY user_id ORDER BY pos)) GROUP BY user_id")
def trapezoid_area(spark, sf_dir):
    return curves.trapezoid(points(spark, sf_dir), "user_id", ["pos"], "pos", "value").select("user_id", F.round("area", 4).alias("area"))


@query(
    f"""SELECT user_id, round(coalesce(sum(a), 0), 4) AS excess FROM (SELECT user_id, (lead(pos) OVER w - pos) * (lead(o) OVER w + o) / 2 AS a FROM
 (SELECT p.user_id, p.pos, greatest(0, p.value - b.base) AS o FROM ({POINTS}) p JOIN (SELECT user_id, quantile_cont(value, 0.1) AS base FROM events GROUP BY user_id) b USING (user_id))
 WINDOW w AS (PARTITION BY user_id ORDER BY pos)) GROUP BY user_id"""
)
def baseline_excess(spark, sf_dir):
    return curves.excess_area(points(spark, sf_dir), "user_id", ["pos"], "pos", "value").select("user_id", F.round("excess", 4).alias("excess"))


@query("SELECT event_id, round(CASE WHEN h > l THEN (value - l) / (h - l) ELSE value END, 9) AS scaled FROM events JOIN (SELECT user_id, min(value) AS l, max(value) AS h FROM events GROUP BY user_id) USING (user_id)")
def minmax_normalise(spark, sf_dir):
    return curves.minmax(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", "value", "scaled").select("event_id", F.round("scaled", 9).alias("scaled"))


@query("SELECT event_id, round(least(greatest(value, a - 1.5 * (b - a)), b + 1.5 * (b - a)), 6) AS value FROM events, (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)")
def winsor_iqr(spark, sf_dir):
    return statistics.winsorised(table(spark, sf_dir, "events").select("event_id", "value"), ["value"]).select("event_id", F.round("value", 6).alias("value"))


@query("SELECT c_custkey, round(CASE WHEN m <= 0 THEN ln(1 + c_acctbal - m) ELSE ln(c_acctbal) END, 9) AS logged FROM customer, (SELECT min(c_acctbal) AS m FROM customer)")
def log_shift(spark, sf_dir):
    return statistics.logged(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("logged")), ["logged"]).select("c_custkey", F.round("logged", 9).alias("logged"))


@query(
    """SELECT feature, n, round(mean, 4) AS mean, round(std_pop, 4) AS std_pop, round(median, 4) AS median, round(q1, 4) AS q1, round(q3, 4) AS q3, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis FROM
 (SELECT feature, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std_pop, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3,
 avg(pow(v - m, 3)) / pow(stddev_pop(v), 3) AS skewness, avg(pow(v - m, 4)) / pow(var_pop(v), 2) - 3 AS kurtosis FROM
 (SELECT 'l_quantity' AS feature, l_quantity AS v, avg(l_quantity) OVER () AS m FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice, avg(l_extendedprice) OVER () FROM lineitem) GROUP BY feature)"""
)
def descriptive_stats(spark, sf_dir):
    out = summaries.describe(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    return out.select("feature", "n", *(F.round(c, 4).alias(c) for c in ("mean", "std_pop", "median", "q1", "q3")), F.round("skewness", 6).alias("skewness"), F.round("kurtosis", 6).alias("kurtosis"))


@query("SELECT l.level, CAST(count(o_orderkey) AS BIGINT) AS n, round(100.0 * count(o_orderkey) / (SELECT count(*) FROM orders), 6) AS pct FROM (VALUES ('F'), ('O'), ('P'), ('X')) l(level) LEFT JOIN orders ON o_orderstatus = level GROUP BY 1")
def confidence_table(spark, sf_dir):
    return summaries.level_shares(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P", "X"]).select("level", "n", F.round("pct", 6).alias("pct"))


@query("SELECT o_orderpriority AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM orders GROUP BY 1")
def value_counts(spark, sf_dir):
    return summaries.value_counts(table(spark, sf_dir, "orders"), "o_orderpriority").select("value", "n", F.round("share", 9).alias("share"))


@query("SELECT l_returnflag AS r, l_linestatus AS c, count(*) AS n FROM lineitem GROUP BY 1, 2")
def crosstab(spark, sf_dir):
    return summaries.crosstab(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'All' ELSE l_returnflag END AS r, CASE WHEN grouping(l_linestatus) = 1 THEN 'All' ELSE l_linestatus END AS c, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def crosstab_margins(spark, sf_dir):
    return summaries.crosstab_margins(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT l_returnflag AS r, l_linestatus AS c, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 9) AS share FROM lineitem GROUP BY 1, 2")
def crosstab_rownorm(spark, sf_dir):
    return summaries.crosstab_shares(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus").select("r", "c", "n", F.round("share", 9).alias("share"))


@query(
    """SELECT o_orderkey, round((o_totalprice - m) / (0.7413 * (q3 - q1)), 6) AS z, abs(o_totalprice - m) >= 1.5 * (q3 - q1) AS outlier, o_totalprice < q1 - 3 * (q3 - q1) OR o_totalprice > q3 + 3 * (q3 - q1) AS extreme FROM orders,
 (SELECT quantile_cont(o_totalprice, 0.5) AS m, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)"""
)
def robust_outliers(spark, sf_dir):
    return statistics.robust_outliers(table(spark, sf_dir, "orders"), "o_totalprice").select("o_orderkey", F.round("z", 6).alias("z"), "outlier", "extreme")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15")
def top_k(spark, sf_dir):
    """The 15 highest, a top-k report."""
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(15)


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6), count(*) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6), count(*) FROM lineitem")
def corr_matrix(spark, sf_dir):
    return statistics.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).select("a", "b", F.round("r", 6).alias("r"), "n")


@query("SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS b FROM lineitem)")
def spearman(spark, sf_dir):
    return statistics.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount").select(F.round("rho", 6).alias("rho"), "n")


@query(
    """WITH o AS (SELECT l_returnflag AS r, l_linestatus AS c, count(*) AS n FROM lineitem GROUP BY 1, 2), nr AS (SELECT r, sum(n) AS nr FROM o GROUP BY 1), nc AS (SELECT c, sum(n) AS nc FROM o GROUP BY 1), t AS (SELECT sum(n) AS t FROM o)
 SELECT round(x, 4) AS chi2, CAST(((SELECT count(*) FROM nr) - 1) * ((SELECT count(*) FROM nc) - 1) AS BIGINT) AS dof, round(sqrt(x / ((SELECT t FROM t) * (least((SELECT count(*) FROM nr), (SELECT count(*) FROM nc)) - 1))), 6) AS cramers_v FROM
 (SELECT sum(pow(coalesce(n, 0) - nr * nc / t, 2) / (nr * nc / t)) AS x FROM nr CROSS JOIN nc CROSS JOIN t LEFT JOIN o USING (r, c))"""
)
def chi2_cramers_v(spark, sf_dir):
    return statistics.chi2(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus").select(F.round("chi2", 4).alias("chi2"), F.col("dof").cast("bigint").alias("dof"), F.round("cramers_v", 6).alias("cramers_v"))


@query(
    """WITH o AS (SELECT o_orderstatus AS r, o_orderpriority AS c, count(*) AS n FROM orders GROUP BY 1, 2), nr AS (SELECT r, sum(n) AS nr FROM o GROUP BY 1), nc AS (SELECT c, sum(n) AS nc FROM o GROUP BY 1), t AS (SELECT sum(n) AS t FROM o)
 SELECT r, c, CAST(coalesce(n, 0) AS BIGINT) AS a, round(nr * nc / t, 6) AS expected, round(coalesce(n, 0) / (nr * nc / t), 6) AS ratio FROM nr CROSS JOIN nc CROSS JOIN t LEFT JOIN o USING (r, c) WHERE nc >= 3 AND nr * nc / t >= 1"""
)
def enrichment(spark, sf_dir):
    return statistics.enrichment(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority").select("r", "c", F.col("a").cast("bigint").alias("a"), F.round("expected", 6).alias("expected"), F.round("ratio", 6).alias("ratio"))


@query()
def fisher_enrichment(spark, sf_dir):
    cells = statistics.with_fisher_p(statistics.enrichment(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"))
    return statistics.adjusted(cells, "p")


@query(
    """SELECT user_id, round(p, 9) AS p, round(least(1, min(raw) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 9) AS p_adj FROM (SELECT user_id, p, k, p * count(*) OVER () / k AS raw FROM
 (SELECT user_id, p, row_number() OVER (ORDER BY p) AS k FROM (SELECT user_id, count(*) FILTER (value > 20) / count(*) AS p FROM events GROUP BY user_id)))"""
)
def bh_adjust(spark, sf_dir):
    p = table(spark, sf_dir, "events").groupBy("user_id").agg((F.count_if(F.col("value") > 20) / F.count("*")).alias("p"))
    return statistics.adjusted(p, "p").select("user_id", F.round("p", 9).alias("p"), F.round("p_adj", 9).alias("p_adj"))


@query(
    """WITH g AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1 HAVING count(*) > 1), t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS mean, sum(n * v) AS w FROM g)
 SELECT round((SELECT sum(n * pow(m - (SELECT mean FROM t), 2)) FROM g) / (k - 1) / (w / (n - k)), 6) AS f, CAST(k - 1 AS BIGINT) AS d1, CAST(n - k AS BIGINT) AS d2 FROM t"""
)
def anova_f(spark, sf_dir):
    out = statistics.anova(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")
    return out.select(F.round("f", 6).alias("f"), F.col("d1").cast("bigint").alias("d1"), F.col("d2").cast("bigint").alias("d2"))


@query(
    """SELECT round(r1 - n1 * (n1 + 1) / 2.0, 2) AS u, n1, n2 FROM (SELECT sum(rk) FILTER (o_orderstatus = 'F') AS r1, count(*) FILTER (o_orderstatus = 'F') AS n1, count(*) FILTER (o_orderstatus = 'O') AS n2 FROM
 (SELECT o_orderstatus, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS rk FROM orders WHERE o_orderstatus IN ('F', 'O')))"""
)
def mann_whitney_u(spark, sf_dir):
    return statistics.mann_whitney(table(spark, sf_dir, "orders"), "o_orderstatus", "F", "O", "o_totalprice").select(F.round("u", 2).alias("u"), "n1", "n2")


@query(
    """SELECT round(max(abs(a / n1 - b / n2)), 9) AS d FROM (SELECT sum(ca) OVER w AS a, sum(cb) OVER w AS b, sum(ca) OVER () AS n1, sum(cb) OVER () AS n2 FROM
 (SELECT o_totalprice AS v, count(*) FILTER (o_orderstatus = 'F') AS ca, count(*) FILTER (o_orderstatus = 'O') AS cb FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1) WINDOW w AS (ORDER BY v))"""
)
def ks_statistic(spark, sf_dir):
    return statistics.kolmogorov(table(spark, sf_dir, "orders"), "o_orderstatus", "F", "O", "o_totalprice").select(F.round("d", 9).alias("d"))


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    return transitions.pairs(orders, group="o_custkey", kind="o_orderstatus", value="o_totalprice", order="o_orderkey", measures=["o_totalprice"], tags=["o_orderpriority"], reference="F", modified="O")


PAIRS = """SELECT m.o_custkey, m.o_orderkey AS mod_o_orderkey, coalesce(r.v, false) AS virtual_ref, r.p AS ref_p, r.t AS ref_t, m.o_totalprice AS mod_p, m.o_totalprice - r.p AS d, m.o_orderpriority IS DISTINCT FROM r.t AS changed FROM
 (SELECT * FROM orders WHERE o_orderstatus = 'O') m LEFT JOIN (SELECT o_custkey, o_totalprice AS p, o_orderpriority AS t, false AS v FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F') WHERE k = 1
 UNION ALL SELECT o_custkey, p, t, true FROM (SELECT o_custkey, avg(o_totalprice) AS p FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) a JOIN (SELECT o_custkey, t FROM (SELECT o_custkey, o_orderpriority AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS k
 FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2) WHERE k = 1) b USING (o_custkey) WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')) r USING (o_custkey)"""


@query(f"SELECT o_custkey, mod_o_orderkey, virtual_ref, round(ref_p, 4) AS ref_price, ref_t AS ref_priority, round(d, 4) AS d_price, changed FROM ({PAIRS})")
def reference_pairing(spark, sf_dir):
    out = order_pairs(spark, sf_dir)
    return out.select("o_custkey", "mod_o_orderkey", F.coalesce("virtual_ref", F.lit(False)).alias("virtual_ref"), F.round("ref_o_totalprice", 4).alias("ref_price"), F.col("ref_o_orderpriority").alias("ref_priority"), F.round("d_o_totalprice", 4).alias("d_price"), F.col("o_orderpriority_changed").alias("changed"))


@query(f"SELECT ref_t AS ref_priority, count(d) AS n, round(avg(d), 3) AS mean, round(stddev_samp(d), 3) AS std, round(quantile_cont(d, 0.25), 3) AS q1, round(quantile_cont(d, 0.5), 3) AS median, round(quantile_cont(d, 0.75), 3) AS q3 FROM ({PAIRS}) GROUP BY 1")
def vector_summary(spark, sf_dir):
    out = summaries.vector_summary(order_pairs(spark, sf_dir), "ref_o_orderpriority", ["d_o_totalprice"])
    return out.select(F.col("ref_o_orderpriority").alias("ref_priority"), "n", *(F.round(c, 3).alias(c) for c in ("mean", "std", "q1", "median", "q3")))


@query(
    f"""SELECT o_custkey, mod_o_orderkey, CASE WHEN abs(d) <= 20000 AND abs(mod_p) <= 20000 THEN 'perturbative' WHEN (d / s1 + mod_p / s2) / sqrt(2) > 0 THEN 'disordering' ELSE 'ordering' END AS tr_type,
 CASE WHEN d < -20000 THEN 'narrowing' WHEN d > 20000 THEN 'widening' ELSE 'stable' END AS shift, round(sqrt(pow(d / s1, 2) + pow(mod_p / s2, 2)), 6) AS magnitude FROM ({PAIRS}), (SELECT stddev_samp(d) AS s1, stddev_samp(mod_p) AS s2 FROM ({PAIRS}))"""
)
def transition_classify(spark, sf_dir):
    limits = {"d_o_totalprice": 20000.0, "mod_o_totalprice": 20000.0}
    out = transitions.classified(order_pairs(spark, sf_dir), "d_o_totalprice", "mod_o_totalprice", "d_o_totalprice", limits)
    return out.select("o_custkey", "mod_o_orderkey", "tr_type", "shift", F.round("magnitude", 6).alias("magnitude"))


@query("SELECT user_id, event_type AS mode FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY 1, 2) WHERE k = 1")
def mode_per_group(spark, sf_dir):
    return summaries.mode_of(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("SELECT o_custkey, first(o_orderpriority ORDER BY o_orderkey) AS first, count(*) AS n, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY 1")
def article_level(spark, sf_dir):
    return transitions.article_votes(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey").drop("mode")


@query("SELECT bin, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT CAST(unnest(range(20)) AS INT) AS bin) LEFT JOIN (SELECT CAST(least(floor((l_quantity - 0) / 2.5), 19) AS INT) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1) USING (bin)")
def histogram(spark, sf_dir):
    return summaries.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 0.0, 50.0, 20)


@query("SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def top_articles(spark, sf_dir):
    """The three groups of greatest change, a top-k report."""
    return summaries.top_groups(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", 3)


@query("SELECT p_partkey, CASE WHEN n < 60 THEN coalesce((SELECT max(p_type) FROM part WHERE p_type LIKE '%other%'), 'other') ELSE p_brand END AS p_brand FROM part JOIN (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) USING (p_brand)")
def rare_collapse(spark, sf_dir):
    return tags.rare_collapsed(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", 60).select("p_partkey", "p_brand")


@query("SELECT p_partkey, CASE WHEN 500 + p_size * 3 < 520 THEN 'lt520' WHEN 500 + p_size * 3 < 560 THEN '520_560' WHEN 500 + p_size * 3 < 600 THEN '560_600' ELSE 'gt600' END AS bin FROM part")
def bin_temperature(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tags.temperature_bin(500 + F.col("p_size") * 3).alias("bin"))


@query("SELECT o_orderkey, coalesce(CASE lower(trim(o_orderpriority)) WHEN '1-urgent' THEN '1-URGENT' WHEN '2-high' THEN '2-HIGH' END, 'none') AS tag FROM orders")
def map_default(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", tags.validated(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"], "none").alias("tag"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '&#x[0-9a-f]+;|&[a-z]+;', '', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM documents")
def normalise_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", titles.normalise(F.col("text")).alias("title"))


@query()
def normalise_text(spark, sf_dir):
    """Whole texts of all documents. SQL's lower-casing and white space differ on other scripts: tests hold it to brute force."""
    return table(spark, sf_dir, "documents").select("doc_id", titles.normalise(F.col("text")).alias("title"))


@query("SELECT doc_id, duplicate_of, size FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS duplicate_of, count(*) OVER (PARTITION BY text) AS size FROM documents) WHERE size > 1")
def exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("t"))  # equal texts, by a digest: texts stay put
    groups = docs.groupBy("t").agg(F.min("doc_id").alias("duplicate_of"), F.count("*").alias("size")).where("size > 1")
    return docs.join(groups, "t").select("doc_id", "duplicate_of", "size")


@query("SELECT doc_id, CAST(CASE WHEN trim(regexp_replace(text, '[ \\n\\t]+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '[ \\n\\t]+', ' ', 'g')), ' ')) END AS INT) AS words FROM documents")
def word_counts(spark, sf_dir):
    from ..functions.text import word_count

    return table(spark, sf_dir, "documents").select("doc_id", word_count(F.col("text")).alias("words"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_flatten(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT q AS query, vec_id, round(d, 4) AS distance, CAST(k AS INT) AS rank FROM (SELECT a.vec_id AS q, b.vec_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS k FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0) WHERE k <= 5")
def knn5(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return statistics.nearest(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding").select("query", "vec_id", F.round("distance", 4).alias("distance"), "rank")


@query(
    """SELECT round((b * (n - k)) / (w * (k - 1)), 4) AS calinski_harabasz FROM (SELECT sum(c * pow(m - mm, 2)) AS b, sum(c * v) AS w, count(DISTINCT label) AS k, sum(c) / count(DISTINCT d) AS n FROM (SELECT *, sum(c * m) OVER (PARTITION BY d) / sum(c) OVER (PARTITION BY d) AS mm FROM
 (SELECT label, d, count(*) AS c, avg(x) AS m, var_pop(x) AS v FROM (SELECT label, unnest(range(64)) AS d, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY 1, 2)))"""
)
def calinski_harabasz(spark, sf_dir):
    return statistics.dispersion(table(spark, sf_dir, "embeddings"), "embedding", "label", 64).select(F.round("calinski_harabasz", 4).alias("calinski_harabasz"))


@query(
    """WITH o AS (SELECT o_orderstatus AS r, o_orderpriority AS c, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT sum(n * (n - 1) / 2.0) AS s, sum(n) AS n FROM o), r AS (SELECT sum(n * (n - 1) / 2.0) AS r FROM (SELECT sum(n) AS n FROM o GROUP BY r)), c AS (SELECT sum(n * (n - 1) / 2.0) AS c FROM (SELECT sum(n) AS n FROM o GROUP BY c))
 SELECT round((s - r * c / (n * (n - 1) / 2.0)) / ((r + c) / 2 - r * c / (n * (n - 1) / 2.0)), 9) AS ari FROM s, r, c"""
)
def adjusted_rand(spark, sf_dir):
    return statistics.rand_index(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority").select(F.round("ari", 9).alias("ari"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def anti_filter(spark, sf_dir):
    refs = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(refs, "c_custkey", "left_anti")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_filter(spark, sf_dir):
    refs = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(refs, "c_custkey", "left_semi")


@query(
    """SELECT k, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' ELSE 'changed' END AS status FROM (SELECT o_custkey AS k, count(*) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) FULL JOIN (SELECT o_custkey AS k, count(*) AS b FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) USING (k) WHERE a IS DISTINCT FROM b"""
)
def manifest_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    a, b = (orders.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("v")) for s in "FO")
    return summaries.outer_diff(a, b, "k", "v")


@query("SELECT l_orderkey, l_linenumber, 'l_quantity' AS name, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem")
def melt(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"], "name", "value")


@query("SELECT o_custkey, min(o_totalprice) FILTER (o_orderstatus = 'F') AS F, min(o_totalprice) FILTER (o_orderstatus = 'O') AS O FROM orders GROUP BY 1")
def pivot(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O"]).agg(F.min("o_totalprice"))


@query("SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k = 1")
def first_wins(spark, sf_dir):
    return summaries.first_of(table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], ["event_id"])


@query(
    """WITH o AS (SELECT o_orderpriority AS s, o_orderstatus AS r, o_custkey % 3 AS c, count(*) AS n FROM orders GROUP BY 1, 2, 3), nr AS (SELECT s, r, sum(n) AS nr FROM o GROUP BY 1, 2), nc AS (SELECT s, c, sum(n) AS nc FROM o GROUP BY 1, 2), t AS (SELECT s, sum(n) AS t FROM o GROUP BY 1)
 SELECT s AS o_orderpriority, round(sum(pow(coalesce(n, 0) - nr * nc / t, 2) / (nr * nc / t)), 6) AS chi2, CAST(any_value(t) AS BIGINT) AS n FROM nr JOIN nc USING (s) JOIN t USING (s) LEFT JOIN o USING (s, r, c) GROUP BY 1"""
)
def stratified_chi2(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("third", F.col("o_custkey") % 3)
    return statistics.stratified(orders, "o_orderpriority", "o_orderstatus", "third").select("o_orderpriority", F.round("chi2", 6).alias("chi2"), "n")


def made_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed-form curve for each supplier: its balance sets the gap and the width of the tail."""
    s = table(spark, sf_dir, "supplier")
    x = F.abs("s_acctbal") % 1000 / 1000
    grid = s.select(F.concat(F.lit("s"), "s_suppkey").alias("sample_id"), (2.4 + 0.4 * x).alias("gap"), (0.04 + 0.06 * x).alias("tail"), F.explode(F.sequence(F.lit(0), F.lit(200))).alias("i"))
    energy = 1.4 + 0.0115 * F.col("i")
    edge = F.when(energy > F.col("gap"), (energy - F.col("gap")) * (energy - F.col("gap")) / energy).otherwise(0.0)
    return grid.select("sample_id", energy.alias("energy"), F.greatest(0.002 * F.exp(F.least(F.lit(0.0), (energy - F.col("gap")) / F.col("tail"))), edge).alias("absorbance"))


@query()
def curve_features(spark, sf_dir):
    return curves.features(made_curves(spark, sf_dir))


@query()
def nested_clusters(spark, sf_dir):
    from ..operators import clusters

    found = curves.features(made_curves(spark, sf_dir)).where("status = 'ok'")
    return clusters.nested(found, k=2).select("sample_id", "macro_cluster", "sub_cluster", "full_label")


@query()
def fuzzy_titles(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("title"))
    return titles.fuzzy_pairs(parts, "p_partkey", "title", 0.85)


@query()
def duplicate_titles(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("title"))
    return titles.duplicates(parts, "p_partkey", "title", 0.85)

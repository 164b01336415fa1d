"""More registered queries: conversions, names, labels, files, look-ups, reshaping and reports, each with its SQL.

They join those of ``queries`` when this module is imported. What stands for a curve, a sample, an article or a file is said there
and with each query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import convert, text
from ..operators import clusters, statistics, summaries, tags, titles, transitions
from ..sources import curves as files
from ..sources import documents
from .queries import query, table

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
IDS = ", ".join(LINE)


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


@query(f"SELECT {IDS}, round(1240.0 / l_quantity, 9) AS energy FROM lineitem")
def energy_of_wavelength(spark, sf_dir):
    return line(spark, sf_dir).select(*LINE, F.round(convert.energy_of(F.col("l_quantity")), 9).alias("energy"))


@query(f"SELECT {IDS}, round(pow(l_quantity * l_discount, 0.5), 9) AS tauc, round(pow(greatest(l_tax, 1e-10), 2) / l_quantity, 12) AS absorbance FROM lineitem")
def tauc_both_ways(spark, sf_dir):
    q, d, t = (F.col(c) for c in ("l_quantity", "l_discount", "l_tax"))
    return line(spark, sf_dir).select(*LINE, F.round(convert.tauc_of(q, d, 0.5), 9).alias("tauc"), F.round(convert.absorbance_of(q, t, 0.5), 12).alias("absorbance"))


@query(f"SELECT {IDS}, round(CASE WHEN l_tax > 0 THEN greatest(l_discount - l_tax, 1e-12) ELSE l_discount END, 12) AS corrected FROM lineitem")
def baseline_removed(spark, sf_dir):
    return line(spark, sf_dir).select(*LINE, F.round(convert.baseline_removed(F.col("l_discount"), F.col("l_tax")), 12).alias("corrected"))


@query(
    f"""SELECT {IDS}, round(CASE WHEN l_discount > 0 THEN l_quantity / 1000 / l_discount ELSE 0.0 END, 9) AS ratio,
 CASE WHEN l_discount < 0.001 THEN '***' WHEN l_discount < 0.01 THEN '**' WHEN l_discount < 0.05 THEN '*' ELSE '' END AS stars FROM lineitem"""
)
def ratio_and_stars(spark, sf_dir):
    return line(spark, sf_dir).select(*LINE, F.round(convert.ratio_of_gap(F.col("l_quantity"), F.col("l_discount")), 9).alias("ratio"), convert.stars(F.col("l_discount")).alias("stars"))


LEVEL = "CASE WHEN {0} < {1} THEN 'low' WHEN {0} < {2} THEN 'medium' ELSE 'high' END"


def level(column: str, a: float, b: float):
    return F.when(F.col(column) < a, "low").when(F.col(column) < b, "medium").otherwise("high")


@query(
    f"""SELECT {IDS}, CAST((a = 'high')::INT + (b = 'high')::INT + (c = 'high')::INT AS INT) AS stars, CASE WHEN 'low' IN (a, b, c) THEN 'low' WHEN 'medium' IN (a, b, c) THEN 'medium' ELSE 'high' END AS worst FROM
 (SELECT *, {LEVEL.format('l_quantity', 10, 30)} AS a, {LEVEL.format('l_tax', 0.02, 0.05)} AS b, {LEVEL.format('l_discount', 0.03, 0.06)} AS c FROM lineitem)"""
)
def confidence_of_three(spark, sf_dir):
    parts = [level("l_quantity", 10, 30), level("l_tax", 0.02, 0.05), level("l_discount", 0.03, 0.06)]
    return line(spark, sf_dir).select(*LINE, convert.quality_stars(*parts).cast("int").alias("stars"), convert.worst_confidence(*parts).alias("worst"))


@query(f"SELECT {IDS}, CASE WHEN 1 - l_discount / 10 >= 0.997 AND l_tax >= 0.10 THEN 'high' WHEN 1 - l_discount / 10 >= 0.990 AND l_tax >= 0.05 THEN 'medium' ELSE 'low' END AS confidence FROM lineitem")
def gap_confidence(spark, sf_dir):
    return line(spark, sf_dir).select(*LINE, convert.confidence_of_gap(1 - F.col("l_discount") / 10, F.col("l_tax")).alias("confidence"))


@query(f"SELECT {IDS}, round(degrees(acos(greatest(-1, least(1, (l_quantity * 3 + l_tax * 40) / (sqrt(l_quantity * l_quantity + l_tax * l_tax) * sqrt(1609.0)))))), 6) AS angle FROM lineitem")
def angle_between(spark, sf_dir):
    return line(spark, sf_dir).select(*LINE, F.round(convert.angle_between([F.col("l_quantity"), F.col("l_tax")], [F.lit(3.0), F.lit(40.0)]), 6).alias("angle"))


@query(f"SELECT {IDS}, list_sort([{{'p': l_discount, 'label': 'a'}}, {{'p': l_tax, 'label': 'b'}}, {{'p': 0.035::DOUBLE, 'label': 'c'}}], 'DESC')[2].label AS second FROM lineitem")
def runner_up(spark, sf_dir):
    both = F.array(*(F.struct(p.alias("p"), F.lit(n).alias("label")) for p, n in ((F.col("l_discount"), "a"), (F.col("l_tax"), "b"), (F.lit(0.035), "c"))))
    return line(spark, sf_dir).select(*LINE, convert.runner_up(both).alias("second"))


@query("SELECT o_orderkey, CASE k WHEN 'reference' THEN 'reference' WHEN 'doped' THEN 'modified' ELSE 'unknown' END AS kind FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'reference' WHEN 'O' THEN 'doped' ELSE 'other' END AS k FROM orders)")
def clean_type(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "reference").when(F.col("o_orderstatus") == "O", "doped").otherwise("other")
    return table(spark, sf_dir, "orders").select("o_orderkey", convert.clean_type(kind).alias("kind"))


@query(
    """SELECT c_custkey, chr(65 + c_nationkey) AS letter, chr(65 + c_nationkey) || ' → ' || c_mktsegment AS change, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Home' ELSE upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' X' END AS label,
 CASE WHEN c_nationkey >= 3 THEN (['red', 'green', 'blue'])[(c_nationkey - 3) % 3 + 1] ELSE 'grey' END AS colour FROM customer"""
)
def labels_of_clusters(spark, sf_dir):
    letter = convert.letter(F.col("c_nationkey"))
    label = convert.label_of(F.when(F.col("c_mktsegment") == "HOUSEHOLD", "HOUSEHOLD").otherwise(F.concat("c_mktsegment", F.lit("_x"))), {"HOUSEHOLD": "Home"})
    return table(spark, sf_dir, "customer").select("c_custkey", letter.alias("letter"), convert.arrow(letter, F.col("c_mktsegment")).alias("change"), label.alias("label"), convert.colour(F.col("c_nationkey") - 3, ["red", "green", "blue"]).alias("colour"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'lab_' || c_custkey ELSE 'plain/' || c_custkey END AS article, c_custkey || '-x' AS of_id FROM customer")
def article_names(spark, sf_dir):
    c = F.col("c_custkey").cast("string")
    folder = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("in/lab_"), c, F.lit("_data/more"))).otherwise(F.concat(F.lit("plain/"), c))
    return table(spark, sf_dir, "customer").select("c_custkey", convert.article_of_folder(folder).alias("article"), convert.article_of_id(F.concat(F.lit("a/b/"), c, F.lit("-x.pdf"))).alias("of_id"))


# Files: a part is one, in its brand's folder.
FILES = """SELECT p_partkey, 'p/' || p_partkey AS path, CASE WHEN p_size % 2 = 0 THEN p_brand || '_data' ELSE p_brand END AS folder,
 CASE p_partkey % 5 WHEN 0 THEN p_name || '_abs_' || p_type WHEN 1 THEN p_name || '_tauc_' || p_type WHEN 2 THEN 'results_' || p_type WHEN 3 THEN p_type || '__' || p_size ELSE p_name END AS stem FROM part"""


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    folder = F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit("_data"))).otherwise(F.col("p_brand"))
    k = F.col("p_partkey") % 5
    stem = F.when(k == 0, F.concat_ws("_abs_", "p_name", "p_type")).when(k == 1, F.concat_ws("_tauc_", "p_name", "p_type")).when(k == 2, F.concat(F.lit("results_"), "p_type")).when(k == 3, F.concat_ws("__", "p_type", "p_size")).otherwise(F.col("p_name"))
    return p.select("p_partkey", F.concat(F.lit("p/"), "p_partkey").alias("path"), folder.alias("folder"), stem.alias("stem"))


@query(
    f"""SELECT p_partkey, CASE WHEN stem LIKE '%\\_abs\\_%' ESCAPE '\\' THEN split_part(stem, '_abs_', 2) WHEN stem LIKE '%\\_tauc\\_%' ESCAPE '\\' THEN split_part(stem, '_tauc_', 2) ELSE stem END AS sample,
 TRY_CAST(nullif(regexp_extract(stem, '__(\\d+)$', 1), '') AS DOUBLE) / 100 AS gap, regexp_replace(stem, '__\\d+$', '') AS plain,
 CASE WHEN lower(stem) LIKE '%\\_abs%' ESCAPE '\\' THEN 'abs' WHEN lower(stem) LIKE '%tauc%' THEN 'tauc' END AS kind FROM ({FILES})"""
)
def names_of_files(spark, sf_dir):
    f, stem = part_files(spark, sf_dir), F.col("stem")
    return f.select("p_partkey", files.sample_name(stem).alias("sample"), files.known_gap(stem).alias("gap"), files.without_gap(stem).alias("plain"), files.kind_of_stem(stem)[0].alias("kind"))


@query(
    f"""SELECT path, folder, stem FROM (SELECT *, min(r) OVER (PARTITION BY folder) AS best FROM (SELECT *, CASE WHEN lower(stem) LIKE '%\\_abs\\_%' ESCAPE '\\' THEN 0 WHEN lower(stem) LIKE '%\\_tauc%' ESCAPE '\\' THEN 1
 WHEN lower(stem) NOT LIKE '%result%' AND lower(stem) NOT LIKE '%analysis%' THEN 2 END AS r FROM ({FILES})) WHERE r IS NOT NULL) WHERE r = best"""
)
def preferred_files(spark, sf_dir):
    return files.preferred(part_files(spark, sf_dir)).select("path", "folder", "stem")


@query(f"SELECT DISTINCT folder FROM ({FILES}) WHERE ends_with(folder, '_data') AND (lower(stem) LIKE '%\\_abs\\_%' ESCAPE '\\' OR lower(stem) LIKE '%\\_tauc%' ESCAPE '\\')")
def data_folders(spark, sf_dir):
    return files.data_folders(part_files(spark, sf_dir))


@query(f"SELECT folder, CAST(regexp_extract(stem, '__(\\d+)$', 1) AS DOUBLE) / 100 AS known_gap FROM (SELECT folder, min(stem) AS stem FROM ({FILES}) WHERE regexp_matches(stem, '__\\d+$') GROUP BY folder)")
def calibrators(spark, sf_dir):
    return files.calibrators(part_files(spark, sf_dir)).select("folder", "known_gap")


@query(
    f"""SELECT s.folder, s.sample, CAST(min(CASE WHEN n = sample THEN 0 WHEN regexp_replace(n, '__\\d+$', '') = sample THEN 1 ELSE 2 END) AS INT) AS match_rank FROM (SELECT DISTINCT folder, p_type AS sample FROM ({FILES}) JOIN part USING (p_partkey)) s
 JOIN (SELECT folder, CASE WHEN stem LIKE '%\\_abs\\_%' ESCAPE '\\' THEN split_part(stem, '_abs_', 2) WHEN stem LIKE '%\\_tauc\\_%' ESCAPE '\\' THEN split_part(stem, '_tauc_', 2) ELSE stem END AS n FROM ({FILES})) f ON f.folder = s.folder AND contains(n, sample) GROUP BY 1, 2"""
)
def spectrum_of_sample(spark, sf_dir):
    f = part_files(spark, sf_dir)
    samples = f.join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("sample")), "p_partkey").select("folder", "sample").distinct()
    return files.match_files(samples, f).where("match_rank is not null").select("folder", "sample", "match_rank")


@query(
    f"""SELECT {IDS}, round(1240.0 / l_quantity, 9) AS energy, l_tax AS absorbance FROM lineitem WHERE l_quantity > 0 AND l_tax > 0"""
)
def absorption_points(spark, sf_dir):
    points = line(spark, sf_dir).select(*LINE, F.col("l_quantity").alias("x"), F.col("l_tax").alias("y"))
    return files.absorption(points).withColumn("energy", F.round("energy", 9))


@query(
    f"""SELECT {IDS}, round(e, 9) AS energy, round(a, 9) AS absorbance, round(pow(a * e, 0.5), 9) AS tauc FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_tax ELSE pow(greatest(l_tax, 1e-10), 2.0) / e END AS a FROM
 (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 1240.0 / l_quantity ELSE l_quantity END AS e FROM lineitem WHERE l_quantity > 0 AND (l_tax > 0 OR (l_linenumber % 2 = 1 AND l_tax >= 0))))"""
)
def spectra_of_both_kinds(spark, sf_dir):
    even = F.col("l_linenumber") % 2 == 0
    points = line(spark, sf_dir).select(*LINE, F.col("l_quantity").alias("x"), F.col("l_tax").alias("y"), F.when(even, "abs").otherwise("tauc").alias("kind"), F.when(~even, 0.5).alias("exponent"))
    return files.spectra(points).select(*LINE, *(F.round(c, 9).alias(c) for c in ("energy", "absorbance", "tauc")))


@query(f"SELECT {IDS}, l_discount AS E_g_eV, l_tax AS A_sub FROM lineitem WHERE l_quantity / 50 >= 0.5 AND l_discount > 0.02")
def covered_cases(spark, sf_dir):
    rows = line(spark, sf_dir).select(*LINE, F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("E_g_eV"), F.col("l_tax").alias("A_sub"), (F.col("l_quantity") / 50).alias("A_sub_coverage"))
    return clusters.prepared(rows, ["E_g_eV", "A_sub"]).drop("A_sub_coverage")


MARKED = "CASE doc_id % 4 WHEN 0 THEN 'Access denied. Request ID: 7 ' WHEN 1 THEN 'see the Supporting Information ' WHEN 2 THEN 'described in the SI ' ELSE '' END"


@query(
    f"""SELECT doc_id, doc_id % 3 <= 1 AND length(t) < 3000 AND (contains(lower(t), 'access denied')::INT + contains(lower(t), 'request id:')::INT + contains(lower(t), 'cookie policy')::INT) >= 2 AS broken,
 regexp_matches(lower(t), 'see\\s+(the\\s+)?support') AS redirects FROM (SELECT doc_id, {MARKED} || coalesce(text, '') AS t FROM documents)"""
)
def error_pages(spark, sf_dir):
    k = F.col("doc_id") % 4
    t = F.concat(F.when(k == 0, "Access denied. Request ID: 7 ").when(k == 1, "see the Supporting Information ").when(k == 2, "described in the SI ").otherwise(""), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", text.broken(t, F.col("doc_id") % 3 + 1).alias("broken"), text.redirects(t).alias("redirects"))


@query(
    """SELECT p_partkey, CASE WHEN t = '' OR ends_with(t, '.pdf') OR contains(t, '/') OR length(t) < 10 OR contains(t, 'Document') OR contains(t, 'untitled') THEN NULL ELSE t END AS title, trim(regexp_replace(p_name, '^[^a-zA-Z0-9]+', '')) AS bare FROM
 (SELECT p_partkey, p_name, trim(CASE p_partkey % 4 WHEN 0 THEN p_name || '.pdf' WHEN 1 THEN ' ' || p_name || ' of ' || p_type || ' ' WHEN 2 THEN 'untitled ' || p_name ELSE p_name END) AS t FROM part)"""
)
def clean_titles(spark, sf_dir):
    k = F.col("p_partkey") % 4
    t = F.when(k == 0, F.concat("p_name", F.lit(".pdf"))).when(k == 1, F.concat(F.lit(" "), "p_name", F.lit(" of "), "p_type", F.lit(" "))).when(k == 2, F.concat(F.lit("untitled "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", titles.clean(t).alias("title"), text.stripped(F.concat(F.lit("■ _ "), "p_name")).alias("bare"))


@query("SELECT doc_id, 'Read this: ' || substr(coalesce(text, ''), 1, 12000) AS prompt FROM documents")
def prompts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.prompt("Read this: %s", F.coalesce("text", F.lit(""))).alias("prompt"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'machinery' END AS file FROM customer")
def match_of_file(spark, sf_dir):
    k = F.col("c_custkey") % 3
    return table(spark, sf_dir, "customer").select("c_custkey", tags.file_match(F.when(k == 0, "BUILDING").when(k == 1, "MACHINERY").otherwise("none"), F.array(F.lit("machinery"), F.lit("BUILDING"))).alias("file"))


@query("SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) = 1 THEN o_orderpriority END AS file_match FROM orders")
def first_sample_of_file(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("article_id"), F.col("o_orderpriority").alias("file_match"), F.col("o_orderkey").alias("sample_index"))
    return tags.first_per_file(rows).select("o_orderkey", "file_match")


@query("SELECT o_orderkey, CASE WHEN t = '3d_macroporous' THEN 'porous_holey' ELSE coalesce(t, 'unknown') END AS tag FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '3d_macroporous' WHEN 'O' THEN 'bulk' END AS t FROM orders)")
def merged_tags(spark, sf_dir):
    t = F.when(F.col("o_orderstatus") == "F", "3d_macroporous").when(F.col("o_orderstatus") == "O", "bulk")
    return table(spark, sf_dir, "orders").select("o_orderkey", tags.merged(t, "morphology_form").alias("tag"))


@query("SELECT c_custkey AS article_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unprocessed_articles(spark, sf_dir):
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("article_id"), F.lit("v1").alias("config_version"))
    return tags.unprocessed(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("article_id")), done, "v1")


@query("SELECT o_orderkey, o_totalprice AS gap, o_totalprice AS E_g FROM orders")
def older_names(spark, sf_dir):
    return tags.with_legacy_names(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("gap")), {"gap": "E_g", "none": "x"})


SAMPLES = "SELECT l_orderkey AS article_num, ' L' || l_linenumber || ' ' AS sample, l_partkey, l_suppkey, l_quantity AS q FROM lineitem"
SYNTHESIS = "SELECT o_orderkey AS article_num, 'l' || (o_orderkey % 7) AS file_match, o_totalprice AS q FROM orders"


def samples_and_synthesis(spark: SparkSession, sf_dir: str, pad: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    samples = line(spark, sf_dir).select(F.col("l_orderkey").alias("article_num"), F.concat(F.lit(pad + "L"), "l_linenumber", F.lit(pad)).alias("sample"), "l_partkey", "l_suppkey", F.col("l_quantity").alias("q"))
    return samples, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_num"), F.concat(F.lit(prefix), F.col("o_orderkey") % 7).alias("file_match"), F.col("o_totalprice").alias("q"))


@query(f"SELECT s.article_num, s.sample, s.l_partkey, s.l_suppkey, s.q, y.file_match, y.q AS q_syn FROM ({SAMPLES}) s LEFT JOIN ({SYNTHESIS}) y ON s.article_num = y.article_num AND lower(trim(s.sample)) = lower(trim(y.file_match))")
def merged_samples(spark, sf_dir):
    return transitions.merged(*samples_and_synthesis(spark, sf_dir, " ", "l"))


@query(f"SELECT s.article_num, trim(s.sample) AS sample, s.l_partkey, s.l_suppkey, s.q, upper(y.file_match) AS file_match, y.q AS q_syn FROM ({SAMPLES}) s LEFT JOIN ({SYNTHESIS}) y ON s.article_num = y.article_num AND trim(s.sample) = upper(y.file_match)")
def merged_exactly(spark, sf_dir):
    return transitions.merged_exact(*samples_and_synthesis(spark, sf_dir, "", "L"))


@query("SELECT o_orderpriority, 'o_totalprice' AS feature, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(stddev_samp(o_totalprice), 4) AS std_samp, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY 1")
def cluster_stats(spark, sf_dir):
    out = summaries.describe(table(spark, sf_dir, "orders"), ["o_totalprice"], ["o_orderpriority"])
    return out.select("o_orderpriority", "feature", "n", *(F.round(c, 4).alias(c) for c in ("mean", "median", "std_samp")), "min", "max")


@query("SELECT o_custkey AS article_num, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS file_samples FROM orders GROUP BY 1")
def samples_of_articles(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("article_num"), F.col("o_orderpriority").alias("sample"))
    return documents.file_samples(rows).withColumn("file_samples", F.array_join("file_samples", ","))


@query(
    """SELECT l_returnflag AS sample, l_linestatus AS feature, round(avg(l_quantity) FILTER (m = 'a'), 6) AS a_mean, round(stddev_pop(l_quantity) FILTER (m = 'a'), 6) AS a_std, round(avg(l_quantity) FILTER (m = 'b'), 6) AS b_mean,
 round(stddev_pop(l_quantity) FILTER (m = 'b'), 6) AS b_std FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END AS m FROM lineitem) GROUP BY 1, 2"""
)
def wide_summary(spark, sf_dir):
    rows = line(spark, sf_dir).select(F.col("l_returnflag").alias("sample"), F.col("l_linestatus").alias("feature"), F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("b").alias("mode"), F.col("l_quantity").alias("value"))
    out = summaries.wide_summary(rows, "sample", "feature", "mode", ["a", "b"])
    return out.select("sample", "feature", *(F.round(c, 6).alias(c) for c in ("a_mean", "a_std", "b_mean", "b_std")))


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) = 1 AS same FROM orders GROUP BY 1")
def unanimous_articles(spark, sf_dir):
    return summaries.unanimous(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")


@query("SELECT o_orderpriority, round(quantile_cont(greatest(0, least(1, (o_totalprice - a) / (b - a))), 0.5), 6) AS median FROM orders, (SELECT quantile_cont(o_totalprice, 0.02) AS a, quantile_cont(o_totalprice, 0.98) AS b FROM orders) GROUP BY 1")
def radar_scale(spark, sf_dir):
    return summaries.normalised(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority").withColumn("median", F.round("median", 6))


@query("SELECT o_orderkey, round(CASE WHEN abs(o_totalprice - 100000) > 1e-10 THEN 100 * 5.0 / abs(o_totalprice - 100000) END, 6) AS error FROM orders")
def relative_errors(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(summaries.relative_error(F.lit(5.0), F.col("o_totalprice") - 100000), 6).alias("error"))


@query(
    """SELECT path, place, page FROM (SELECT path, page, sum(n + 2) OVER w AS e, sum(n + 2) OVER w - n - 2 AS b FROM (SELECT CAST(floor(doc_id / 4) AS BIGINT) AS path, doc_id % 4 AS page, length(coalesce(text, '')) AS n FROM documents) WINDOW w AS (PARTITION BY path ORDER BY page))
 JOIN (SELECT DISTINCT CAST(floor(doc_id / 4) AS BIGINT) AS path, unnest([0, 1000, 4000]) AS place FROM documents) USING (path) WHERE place >= b AND place < e"""
)
def page_of_place(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 4).alias("path"), (F.col("doc_id") % 4).alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    places = docs.select("path").distinct().select("path", F.explode(F.array(F.lit(0), F.lit(1000), F.lit(4000))).alias("place"))
    return documents.page_of(docs, places)


@query(
    """WITH d AS (SELECT CAST(floor(doc_id / 5) AS BIGINT) AS folder, 's' || (doc_id % 5) AS stem, md5(coalesce(text, '')) AS t, doc_id % 5 >= 3 AS sup FROM documents),
 a AS (SELECT * FROM d WHERE NOT sup), b AS (SELECT folder, CASE WHEN stem = 's3' THEN 's1 more' ELSE stem END AS s, t AS st FROM d WHERE sup)
 SELECT a.folder, a.stem, arg_min(st, (CASE WHEN starts_with(s, stem) THEN '0' ELSE '1' END) || s) AS supplement_text FROM a LEFT JOIN b ON a.folder = b.folder GROUP BY 1, 2"""
)
def supplements(spark, sf_dir):
    k = F.col("doc_id") % 5
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 5).alias("folder"), F.when(k == 3, "s1 more").otherwise(F.concat(F.lit("s"), k)).alias("stem"), F.md5(F.coalesce("text", F.lit(""))).alias("text"), (k >= 3).alias("is_supplement"))
    return documents.with_supplement(docs).select("folder", "stem", "supplement_text")


@query(
    """WITH p AS (SELECT m.o_custkey AS article, m.o_orderkey AS mod, r.t AS ref, m.o_orderpriority AS m FROM (SELECT * FROM orders WHERE o_orderstatus = 'O') m JOIN (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS t FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) r USING (o_custkey))
 SELECT article, 'priority' AS tag, arg_min(ref, mod) AS ref, string_agg(DISTINCT m, ', ' ORDER BY m) AS mods, bool_or(m <> ref) AS changed FROM p GROUP BY 1"""
)
def changes_of_tags(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    refs = orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("article")).agg(F.min_by("o_orderpriority", "o_orderkey").alias("ref_priority"))
    mods = orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("article"), "o_orderkey", F.col("o_orderpriority").alias("mod_priority"))
    return transitions.tag_changes(mods.join(refs, "article"), "article", ["priority"], "o_orderkey")


@query(
    """SELECT o_orderkey, o_totalprice AS posterior_minority, coalesce(f, 'unknown') AS flag FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15)
 LEFT JOIN (SELECT l_orderkey AS o_orderkey, min(l_returnflag) AS f FROM lineitem GROUP BY 1) USING (o_orderkey)"""
)
def border_report(spark, sf_dir):
    """The 15 rows nearest to the border, a top-n report."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("posterior_minority"))
    return clusters.boundary_samples(rows, line(spark, sf_dir).select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("flag")), ["flag"], "o_orderkey")


@query(
    """SELECT o_orderpriority, o_orderkey, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY round(d, 12), o_orderkey) AS k FROM
 (SELECT *, sqrt(pow(x - avg(x) OVER w, 2) + pow(y - avg(y) OVER w, 2)) AS d FROM (SELECT o_orderpriority, o_orderkey, o_totalprice / 1e5 AS x, o_custkey / 1e3 AS y FROM orders) WINDOW w AS (PARTITION BY o_orderpriority))) WHERE k = 1"""
)
def cluster_representatives(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", (F.col("o_totalprice") / 1e5).alias("x"), (F.col("o_custkey") / 1e3).alias("y"))
    return clusters.representatives(rows, "o_orderpriority", ["x", "y"], "o_orderkey").select("o_orderpriority", "o_orderkey", F.round("distance", 6).alias("distance"))


@query("SELECT o_orderkey, coalesce(p >= 0.7, false) AS certain FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 300000 END AS p FROM orders)")
def certain_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 300000).alias("macro_cluster_prob"))
    return clusters.certain(rows).select("o_orderkey", "certain")


@query(
    """WITH o AS (SELECT l_returnflag AS r, l_linestatus AS c, count(*) AS n FROM lineitem GROUP BY 1, 2), nr AS (SELECT r, sum(n) AS nr FROM o GROUP BY 1), nc AS (SELECT c, sum(n) AS nc FROM o GROUP BY 1), t AS (SELECT sum(n) AS t FROM o),
 g AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) AS v FROM lineitem GROUP BY 1), s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS mean, sum(n * v) AS w FROM g)
 SELECT 'chi2' AS kind, 'l_linestatus' AS name, round(sum(pow(coalesce(n, 0) - nr * nc / t, 2) / (nr * nc / t)), 4) AS statistic, CAST(any_value(t) AS BIGINT) AS n FROM nr CROSS JOIN nc CROSS JOIN t LEFT JOIN o USING (r, c)
 UNION ALL SELECT 'anova', 'l_quantity', round((SELECT sum(n * pow(m - (SELECT mean FROM s), 2)) FROM g) / (k - 1) / (w / (n - k)), 4), CAST(n AS BIGINT) FROM s"""
)
def tests_of_groups(spark, sf_dir):
    return statistics.group_tests(line(spark, sf_dir), "l_returnflag", ["l_linestatus"], ["l_quantity"]).select("kind", "name", F.round("statistic", 4).alias("statistic"), "n")


@query("SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 9) AS o_totalprice FROM orders")
def standard_scale(spark, sf_dir):
    return statistics.scaled(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]).withColumn("o_totalprice", F.round("o_totalprice", 9))


@query("SELECT o_orderkey, round((o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()), 9) AS o_totalprice FROM orders")
def minmax_scale(spark, sf_dir):
    return statistics.scaled(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], "minmax").withColumn("o_totalprice", F.round("o_totalprice", 9))


@query("SELECT o_orderkey, round((o_totalprice - m) / (b - a), 9) AS o_totalprice FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS m, quantile_cont(o_totalprice, 0.75) AS b FROM orders)")
def robust_scale(spark, sf_dir):
    return statistics.scaled(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], "robust").withColumn("o_totalprice", F.round("o_totalprice", 9))


@query("SELECT user_id AS sample_id, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 9) AS stability, count(*) AS n FROM events GROUP BY 1")
def label_stability(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample_id"), F.col("event_type").alias("label"), F.lit("error").alias("reference"), F.col("event_id").alias("iteration"), F.lit(1.0).alias("ari"), F.lit(2).alias("bic_k"))
    return clusters.stability(runs)[0].withColumn("stability", F.round("stability", 9))


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 20")
def worst_of_groups(spark, sf_dir):
    """The 20 highest of each group, a top-k report."""
    return transitions.top_rows(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), "o_orderpriority", "o_totalprice", "o_orderkey", 20)


@query("SELECT o_orderpriority, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 9) AS f, round(avg(CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.0 END), 9) AS dear FROM orders GROUP BY 1")
def group_shares(spark, sf_dir):
    out = statistics.mixture_shares(table(spark, sf_dir, "orders"), "o_orderpriority", {"f": F.col("o_orderstatus") == "F", "dear": F.col("o_totalprice") > 200000})
    return out.select("o_orderpriority", "n", F.round("f", 9).alias("f"), F.round("dear", 9).alias("dear"))


@query("SELECT s_name AS path FROM supplier ORDER BY 1 LIMIT 7")
def trial_run(spark, sf_dir):
    """The first 7 by name: the limit of a trial run."""
    return documents.first_files(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("path")), 7)


@query("SELECT p_partkey, title FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS title, CASE p_size % 3 WHEN 0 THEN 'Reviews' ELSE p_brand END AS folder, p_partkey % 4 = 0 AS dup FROM part) WHERE NOT dup AND folder <> 'Reviews'")
def files_to_extract(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("folder", F.when(F.col("p_size") % 3 == 0, "Reviews").otherwise(F.col("p_brand"))).withColumn("filename", F.concat("p_partkey", F.lit(".pdf")))
    meta = p.where("p_partkey % 2 = 0").select(F.concat_ws("/", "folder", "filename").alias("key"), F.col("p_type").alias("title"), (F.col("p_partkey") % 4 == 0).alias("is_duplicate"))
    return documents.to_extract(documents.with_metadata(p.select("p_partkey", "folder", "filename"), meta)).select("p_partkey", "title")


@query(
    """WITH b AS (SELECT l_suppkey AS path, l_linenumber AS page, l_quantity AS x, l_extendedprice AS y, l_returnflag || l_orderkey AS t FROM lineitem), s AS (SELECT path, page, count(*) FILTER (x < 25) AS l, count(*) FILTER (x >= 25) AS r FROM b GROUP BY 1, 2),
 p AS (SELECT path, page, string_agg(t, chr(10) ORDER BY CASE WHEN l > 3 AND r > 3 AND x >= 25 THEN 1 ELSE 0 END, y, x, t) AS t FROM b JOIN s USING (path, page) GROUP BY 1, 2) SELECT path, md5(string_agg(t, chr(10) || chr(10) ORDER BY page)) AS text FROM p GROUP BY 1"""
)
def two_column_text(spark, sf_dir):
    blocks = line(spark, sf_dir).select(F.col("l_suppkey").alias("path"), F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.lit(50.0).alias("width"), F.concat("l_returnflag", "l_orderkey").alias("text"))
    return documents.two_columns(blocks).withColumn("text", F.md5("text"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS tag, 'a' AS part FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus, 'b' FROM lineitem")
def stacked(spark, sf_dir):
    rows = line(spark, sf_dir)
    return rows.select(*LINE, F.col("l_returnflag").alias("tag"), F.lit("a").alias("part")).unionByName(rows.select(*LINE, F.col("l_linestatus").alias("tag"), F.lit("b").alias("part")))

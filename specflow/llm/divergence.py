"""How the sources of a language differ in their words: smoothed shares of terms, counted and compared by DuckDB in shards.

Null texts, languages and sources are empty strings, which are groups like any other. Rows that repeat count again. Texts are read whole: one longer than ``PIECE``
is cut where no term is, and its terms meet again before documents are counted. Only the columns named are read, so others may
have any name. An empty table gives no rows.

1. Tasks count terms with SQL over Arrow batches, and combine what they have; Spark adds up (language, source, term), a row each.
2. These rows are dealt into shards by a hash of language and term, of a bounded number of rows. SQL keeps the terms that enough
   documents of a language have. Spark adds up what shares need: a row a group.
3. The same shards get these rows of their languages, make every share with 128-bit integers, and return, of each pair of sources,
   what the terms of the shard add to the distance, and of each group its best terms. Spark merges sums and rankings.

A source has no row for a term that it lacks. With z the share of such a term, a pair's distance is V |z_a - z_b| and corrections of
the terms that one of them has, so a shard's work follows the rows that there are, not terms times pairs of sources.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, scratch
from .decontaminate import lowered

#: What a term is, and what is added to a count; shares are parts of ``ONE``.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
OUTSIDE = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")
ADDED, ONE = 5, 1_000_000_000
#: Characters after which a text may be cut.
PIECE = 1 << 20
#: Rows of a shard, and of a task's counts before it combines or returns them.
SHARD, HELD = 50_000, 400_000

COUNTED = "lang string, source string, term string, n bigint, docs bigint"
#: Terms of documents, then of groups; the empty term stands for the group itself.
IN_PIECES = "SELECT i, lang, source, unnest(regexp_extract_all(text, ?)) AS term FROM pieces"
OF_DOCUMENTS = f"SELECT i, lang, source, term, count(*) AS n FROM ({IN_PIECES}) GROUP BY i, lang, source, term"
OF_GROUPS = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM ({}) GROUP BY lang, source, term"
ADD_UP = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM held GROUP BY lang, source, term"
KEPT = """
SELECT shard, lang, source, term, n, CAST(total AS BIGINT) AS total, place = 1 AS first
FROM (SELECT *, sum(n) OVER w AS total, sum(docs) OVER w AS all_docs, row_number() OVER (PARTITION BY lang, term ORDER BY source) AS place FROM rows WINDOW w AS (PARTITION BY lang, term))
WHERE all_docs >= ?"""
SHARES = f"""
CREATE OR REPLACE TEMP TABLE g AS SELECT lang, source, v, own + {ADDED} * v AS base, every + {ADDED} * v AS lang_base, CASE WHEN v > 0 THEN 1 + ({ONE}::HUGEINT * {ADDED}) // (own + {ADDED} * v) END AS z FROM rows WHERE term IS NULL;
CREATE OR REPLACE TEMP TABLE p AS SELECT lang, source, term, z, 1 + ({ONE}::HUGEINT * (n + {ADDED})) // base AS p, 1 + ({ONE}::HUGEINT * (total + {ADDED})) // lang_base AS q FROM rows JOIN g USING (lang, source) WHERE term IS NOT NULL"""
PARTS = """
SELECT lang, a AS source, 'pair' AS part, b AS item, CAST(sum(d) AS BIGINT) AS value FROM (
 SELECT p.lang, least(p.source, g.source) AS a, greatest(p.source, g.source) AS b, abs(p.p - g.z) - abs(p.z - g.z) AS d FROM p JOIN g ON p.lang = g.lang AND p.source <> g.source
 UNION ALL SELECT x.lang, x.source, y.source, abs(x.p - y.p) - abs(x.p - y.z) - abs(y.p - x.z) + abs(x.z - y.z) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source < y.source)
GROUP BY lang, a, b
UNION ALL
SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= ?"""


@lru_cache(maxsize=1)
def engine():
    """A worker's own DuckDB, of one thread, that writes nothing to disk."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})


def answered(sql: str, values: list | None = None, **tables) -> pa.Table:
    db = engine()
    for name, rows in tables.items():
        db.register(name, rows)
    found = db.sql(sql, params=values or []).to_arrow_table()
    for name in tables:
        db.unregister(name)
    return found


def pieces(text: str):
    """The text, cut after ``PIECE`` characters or more where no term goes on."""
    begin = 0
    while len(text) - begin > PIECE:
        gap = OUTSIDE.search(text, begin + PIECE)
        if gap is None:
            break
        yield text[begin : gap.start()]
        begin = gap.start()
    yield text[begin:]


def counted(stream):
    """Batches of lang, source, text as counts of (lang, source, term): n and documents."""
    held: list[pa.Table] = []
    for batch in stream:
        rows = pa.table(batch.columns, names=["lang", "source", "text"]).append_column("i", pa.array(range(batch.num_rows)))
        if batch.num_rows and max(map(len, rows["text"].to_pylist())) > PIECE:
            parts = [{"i": r["i"], "lang": r["lang"], "source": r["source"], "text": t} for r in rows.to_pylist() for t in pieces(r["text"])]
            kinds = pa.schema([("i", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("text", pa.string())])
            cut = [answered(OF_DOCUMENTS, [TERM], pieces=pa.Table.from_pylist([x], kinds)) for x in parts]
            of = answered(OF_GROUPS.format("SELECT i, lang, source, term, sum(n) AS n FROM cut GROUP BY i, lang, source, term"), cut=pa.concat_tables(cut, promote_options="permissive"))
        else:
            of = answered(OF_GROUPS.format(OF_DOCUMENTS), [TERM], pieces=rows)
        held += [of, answered("SELECT DISTINCT lang, source, '' AS term, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS docs FROM pieces", pieces=rows)]
        if sum(t.num_rows for t in held) > HELD:
            held = [answered(ADD_UP, held=pa.concat_tables(held))]
            if held[0].num_rows > HELD // 2:
                yield from held[0].to_batches()
                held = []
    if held:
        yield from answered(ADD_UP, held=pa.concat_tables(held)).to_batches()


def term_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n, docs (how many documents of the group have the term), written to the shared folder; a row with an
    empty term for each group."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"), lowered(F.col(text)).alias("text"))
    at = scratch(docs.sparkSession, "term-counts")
    rows.mapInArrow(counted, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).write.parquet(at)
    return docs.sparkSession.read.parquet(at)


def audit(docs: DataFrame, *, least_docs: int = 30, top: int = 50, shard: int = SHARD, **names) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: the sum of the differences of all shares from another source of the
    language, all of them; part ``term``: the terms whose share exceeds the language's most, ``top`` at most."""
    spark = docs.sparkSession
    counts = term_counts(docs, **names)
    groups, terms = counts.where("term = ''").select("lang", "source"), counts.where("term <> ''")
    size = counts.agg(F.count_if(F.col("term") == "").alias("groups"), F.count("*").alias("rows")).first()
    shards = max(1, -(-size["rows"] // max(shard, 4 * size["groups"])))  # a shard gets a row for each group, too
    dealt = terms.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int"))
    at = scratch(spark, "kept-terms")
    kinds = "shard int, lang string, source string, term string, n bigint, total bigint, first boolean"
    dealt.groupBy("shard").applyInArrow(lambda t: answered(KEPT, [least_docs], rows=t), kinds).write.parquet(at)
    kept = spark.read.parquet(at)

    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    every = kept.groupBy("lang").agg(F.sum("n").alias("every"), F.count_if("first").alias("v"))
    known = groups.join(own, ["lang", "source"], "left").join(every, "lang", "left").na.fill(0, ["own", "every", "v"])
    at = scratch(spark, "term-groups")
    known.write.parquet(at)
    known = spark.read.parquet(at)

    absent = lambda kind: F.lit(None).cast(kind)
    told = kept.select("shard", "lang").distinct().join(known, "lang").select("shard", "lang", "source", absent("string").alias("term"), absent("bigint").alias("n"), absent("bigint").alias("total"), "own", "every", "v")
    rows = told.unionByName(kept.drop("first"), allowMissingColumns=True)

    def parts(t: pa.Table) -> pa.Table:
        engine().register("rows", t)
        engine().execute(SHARES)
        return answered(PARTS, [top])

    at = scratch(spark, "term-parts")
    rows.groupBy("shard").applyInArrow(parts, "lang string, source string, part string, item string, value bigint").write.parquet(at)
    found = spark.read.parquet(at)

    # pairs of a language's sources meet in SALT tasks; z is the share of a term that a source lacks
    salt = 16
    z = F.when(F.col("v") > 0, 1 + F.expr(f"{ONE * ADDED} div (own + {ADDED} * v)"))
    left = known.select("lang", "source", "v", z.alias("za"), F.pmod(F.xxhash64("source"), F.lit(salt)).alias("s"))
    right = known.select("lang", F.col("source").alias("item"), z.alias("zb"), F.explode(F.sequence(F.lit(0), F.lit(salt - 1)).cast("array<bigint>")).alias("s"))
    pairs = left.join(right, ["lang", "s"]).where("source < item").select("lang", "source", "item", F.coalesce(F.col("v") * F.abs(F.col("za") - F.col("zb")), F.lit(0)).alias("value"))
    sums = pairs.unionByName(found.where("part = 'pair'").select("lang", "source", "item", "value")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = both.withColumn("rank", F.row_number().over(order))
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(best)

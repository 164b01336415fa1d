"""Quality rules, with DataFrame functions only: base counts, and divergence from a language's reference histograms.

Two histograms of a text are compared to those of all documents of its language: of character classes, and of common
words. The common words of a language are the ``COMMON`` words that its documents have most often, learned from all of them
for every language (of equals the lesser come first); a further cell counts all other words. The Jensen-Shannon distance
(square root of the divergence to base 2, 0 to 1) of either beyond its limit rejects a text. A text with fewer than
``MIN_WORDS`` words or ``MIN_CHARS`` characters is too short for a histogram and is not judged by distance, one with fewer
than ``MIN_COMMON`` words not by its common words; nor is a language with fewer than ``MIN_DOCS`` documents to make a
reference. A null or unknown language is compared to the characters of all documents together.

Null texts count as empty: no words, so the base rules reject them. Repeated rows are judged alike. Columns of any name
pass: those of the input are carried in one struct. References are sums over all documents, and a table with one row for each
language; what reaches the driver is one row, that of all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

#: Least words and characters for the classes of characters, words for the common words, documents of a reference.
MIN_WORDS, MIN_CHARS, MIN_COMMON, MIN_DOCS = 50, 200, 100, 20
#: Limits of the distances of character classes and of common words.
CHAR_LIMIT, WORD_LIMIT = 0.25, 0.33
#: The white space between words, symbols.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]", "[#*$%&|<>]"
#: Common words of a language.
COMMON = 20
CLASSES = ("lower", "space", "upper", "digit", "point", "symbol", "other")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def with_chars(docs: DataFrame, text: str) -> DataFrame:
    """Adds t, the text, size, its characters, and chars, the counts of its character classes as an array."""
    out = docs.withColumn("t", F.coalesce(F.col(text), F.lit("")))
    # each class is taken out of what the commoner ones left, so later passes see little text
    patterns = ["[a-z]+", SPACE + "+", "[A-Z]+", "[0-9]+", r"[.,;:!?'\"()-]+", r"[\x00-\x7F]+"]
    out = out.withColumn("size", F.length("t"))
    rest, before = "t", F.col("size")
    taken = []
    for i, p in enumerate(patterns):
        out = out.withColumn(f"r{i}", F.regexp_replace(rest, p, "")).withColumn(f"n{i}", F.length(f"r{i}"))
        taken.append(before - F.col(f"n{i}"))
        rest, before = f"r{i}", F.col(f"n{i}")
    return out.withColumn("chars", F.array(*(x.cast("double") for x in [*taken, before]))).drop(*(f"{c}{i}" for c in "rn" for i in range(len(patterns))))


def with_common(docs: DataFrame) -> DataFrame:
    """docs: hashes, those of the words, and list, those of common words or null. Adds common, their counts and that of all others."""
    out = docs.withColumn("listed", F.filter("hashes", lambda h: F.array_contains("list", h)))
    # a column that a lambda uses is computed for each element if nothing else uses it: hence the test of its size
    out = out.withColumn("counts", F.when(F.size("listed") >= 0, F.transform("list", lambda c: (F.size("listed") - F.size(F.array_remove("listed", c))).cast("double"))))
    return out.withColumn("common", F.concat("counts", F.array((F.size("hashes") - F.size("listed")).cast("double")))).drop("listed", "counts")


def shares_of(counts: str) -> Column:
    """An array of counts as shares, null if there are none."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares; 0 if either is null."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.coalesce(F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, y: s + y))), F.lit(0.0))


def shares(counts: list[float]) -> Column:
    return F.array(*(F.lit(x / sum(counts)) for x in counts)) if sum(counts) else F.lit(None).cast("array<double>")


def common_words(docs: DataFrame) -> DataFrame:
    """docs: lang, text. Returns lang, list (the commonest words, most frequent first) and common (their counts over all documents,
    and that of all other words). Words combine before they are shuffled, and of each language only a task's best rows are."""
    words = docs.where("lang is not null").select("lang", F.explode(words_of(F.col("text"))).alias("w"))
    counts = words.groupBy("lang", "w").agg(F.count("*").alias("n"))
    best = counts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).where(F.col("k") <= COMMON)
    best = best.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "w", F.col("n").cast("double").alias("n")))).alias("top"))
    return best.select("lang", F.col("top.w").alias("list"), F.col("top.n").alias("counts"))


def references(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> tuple[DataFrame, list[float]]:
    """ref_lang, own_chars (shares), list (hashes of the common words) and own_common (shares) of each language with enough documents, and the character
    counts of all documents. The table is written to the shared folder: its size is known then, and the join with it planned
    by that."""
    spark, rows = docs.sparkSession, docs.select(F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = with_chars(rows, "text").withColumn("n_words", F.size(words_of(F.col("text"))))
    sums = [F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))]
    at = scratch(spark, "characters")
    counted.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_words").cast("double").alias("n_words"), *sums).write.parquet(at)
    by = spark.read.parquet(at)
    total = by.agg(*(F.sum(f"c{i}") for i in range(len(CLASSES)))).first()
    by = by.where((F.col("n") >= MIN_DOCS) & F.col("lang").isNotNull()).withColumn("c", F.array(*(f"c{i}" for i in range(len(CLASSES)))))
    by = by.join(common_words(rows), "lang", "left")
    rest = F.col("n_words") - F.aggregate("counts", F.lit(0.0), lambda a, x: a + x)
    by = by.withColumn("common", F.concat("counts", F.array(rest)))
    at = scratch(spark, "references")
    by.select(F.col("lang").alias("ref_lang"), shares_of("c").alias("own_chars"), F.transform("list", lambda w: F.xxhash64(w)).alias("list"), shares_of("common").alias("own_common")).write.parquet(at)
    return spark.read.parquet(at), [x or 0.0 for x in total]


#: Columns that ``judge`` adds.
JUDGED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")


def rows_judged(docs: DataFrame, refs: tuple[DataFrame, list[float]], *, text: str = "text", lang: str = "lang") -> DataFrame:
    """row, a struct of the columns of ``docs``, and the ``JUDGED`` columns."""
    own, every = refs
    clean = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    clean = clean.join(own, F.col("lang") == F.col("ref_lang"), "left")
    out = with_chars(clean, "text").withColumn("words", words_of(F.col("t"))).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    out = with_common(out)
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("words")
    at = F.when(n >= 5, F.sequence(F.lit(0), n - 5)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(at, lambda i: F.xxhash64(*(F.get("hashes", i + k) for k in range(5))))
    out = out.withColumn("lines", lines).withColumn("windows", windows)
    pairs = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda x, j: F.coalesce(F.get("sorted", j)["h"] == x["h"], F.lit(False))
    twice = F.transform(F.filter("sorted", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])
    out = out.withColumn("twice", F.array_sort(twice))
    start = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate("twice", start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(5), i - a["last"])).alias("n")))["n"]
    out = out.withColumns(
        {
            "n_words": n.cast("bigint"), "word_chars": F.length(F.array_join("words", "")).cast("bigint"),
            "n_symbols": (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("bigint"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"), "n_repeat_words": covered,
        }
    )
    chars = F.when(F.col("ref_lang").isNotNull(), F.col("own_chars")).otherwise(shares(every))
    out = out.withColumn("char_shares", shares_of("chars")).withColumn("common_shares", shares_of("common")).withColumn("ref_chars", chars)
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    long = (F.col("n_words") >= MIN_WORDS) & (F.col("size") >= MIN_CHARS)
    out = out.withColumn("char_distance", F.when(long, distance(F.col("char_shares"), F.col("ref_chars"))))
    out = out.withColumn("word_distance", F.when(long & (F.col("n_words") >= MIN_COMMON), distance(F.col("common_shares"), F.col("own_common"))))
    near = (F.coalesce("char_distance", F.lit(0.0)) <= CHAR_LIMIT) & (F.coalesce("word_distance", F.lit(0.0)) <= WORD_LIMIT)
    return out.withColumn("kept", ~F.col("base_failed") & near).select("row", *JUDGED)


def judge(docs: DataFrame, refs: tuple[DataFrame, list[float]], **options) -> DataFrame:
    """The columns of ``docs`` and the ``JUDGED`` ones, which take the place of input columns of their names."""
    return rows_judged(docs, refs, **options).select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in JUDGED), *JUDGED)


def quality(docs: DataFrame, **options) -> DataFrame:
    """``judge`` with references from the documents themselves."""
    return judge(docs, references(docs, **options), **options)


def keep(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs``, all of them as they are, rows that the rules keep. The filter must follow the columns that it
    needs: pushed below them it would hold a copy of each for every use of it, so a column that is not deterministic stands in
    the way."""
    judged = rows_judged(docs, references(docs, **options), **options).withColumn("at", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("at") >= 0)).select("row.*")

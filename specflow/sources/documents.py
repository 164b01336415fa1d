"""Literature inputs: PDF text behind a pluggable extractor, section files, synthesis answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLES = "struct<samples:array<map<string,string>>, drs_instrument:string, general_notes:string>"


def pdf_files(spark: SparkSession, root: str, supplements: bool = True) -> DataFrame:
    """path, folder, filename, content of PDF files; without supplements, names that look like one are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(root)
    out = files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "content")
    return out if supplements else out.where(~F.lower("filename").rlike("_sup|_si|supporting"))


def with_text(files: DataFrame, extractors: list[Callable[[bytes], dict]]) -> DataFrame:
    """text, n_pages, title, author, error by the first extractor that succeeds. An extractor takes a file's bytes and returns
    a dict with some of these; none is built in, as none of the usual libraries is required."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for content in batch["content"]:
                found, error = {}, "no extractor"
                for extract in extractors:
                    try:
                        found, error = extract(bytes(content)), None
                        break
                    except Exception as e:  # the next one may do
                        error = str(e)
                rows.append((found.get("text"), found.get("n_pages"), found.get("title"), found.get("author"), error))
            yield pd.concat([batch[["path", "folder", "filename"]].reset_index(drop=True), pd.DataFrame(rows, columns=["text", "n_pages", "title", "author", "error"])], axis=1)

    return files.mapInPandas(run, "path string, folder string, filename string, text string, n_pages int, title string, author string, error string")


#: Folders of articles that have no experimental section.
SKIPPED = ("theoretical", "reviews")


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    """key (folder/filename), title, author, is_duplicate, duplicate_of of a CSV file with a header; columns that it has not are null,
    a missing flag is false. Of rows with the same key the last one counts."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    column = lambda name: F.col(name) if name in rows.columns else F.lit(None).cast("string").alias(name)
    flag = F.coalesce(F.lower(column("is_duplicate")) == "true", F.lit(False))
    named = rows.select(F.concat_ws("/", "folder", "filename").alias("key"), column("title").alias("title"), column("author").alias("author"), flag.alias("is_duplicate"), column("duplicate_of").alias("duplicate_of"), F.monotonically_increasing_id().alias("_at"))
    return named.groupBy("key").agg(F.max_by(F.struct("title", "author", "is_duplicate", "duplicate_of"), "_at").alias("r")).select("key", "r.*")


def with_metadata(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """files: folder, filename. Adds the metadata of each; a file without any is no duplicate."""
    return files.join(metadata, F.concat_ws("/", "folder", "filename") == F.col("key"), "left").drop("key").withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)))


def to_extract(files: DataFrame) -> DataFrame:
    """files: folder, is_duplicate. Those that are no duplicates and not in a folder without experimental sections."""
    return files.where(~F.col("is_duplicate") & ~F.lower("folder").isin(*SKIPPED))


def first_files(files: DataFrame, n: int | None = None) -> DataFrame:
    """The first n files by path, for a trial run; all of them without n."""
    return files if n is None else files.orderBy("path").limit(n)


def two_columns(blocks: DataFrame) -> DataFrame:
    """Text of pages from blocks (path, page, x, y, width, text): the left column before the right one where both have more
    than three blocks, else from top to bottom."""
    left = F.col("x") < F.col("width") / 2
    sides = blocks.groupBy("path", "page").agg(F.count_if(left).alias("l"), F.count_if(~left).alias("r"))
    two = (F.col("l") > 3) & (F.col("r") > 3)
    order = F.struct(F.when(two & ~left, 1).otherwise(0).alias("side"), "y", "x", "text")
    pages = blocks.join(sides, ["path", "page"]).groupBy("path", "page").agg(F.array_sort(F.collect_list(order)).alias("b"))
    pages = pages.select("path", "page", F.array_join(F.transform("b", lambda b: b["text"]), "\n").alias("text"))
    return pages.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n\n").alias("text"))


def sections(spark: SparkSession, path: str) -> DataFrame:
    """Articles of a section file."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("articles").alias("a")).select("a.*")


def write_sections(articles: DataFrame, path: str) -> None:
    """One JSON document with a summary and all articles: of a bounded collection, as its format is one document."""
    summary = F.struct(F.count("*").alias("n_articles"), F.sum("word_count").alias("words"), F.count_if(F.col("confidence") == "high").alias("high"))
    articles.agg(summary.alias("metadata"), F.collect_list(F.struct(*articles.columns)).alias("articles")).coalesce(1).write.json(path)


def file_samples(files: DataFrame) -> DataFrame:
    """Samples of each article, in the order of their names."""
    return files.groupBy("article_num").agg(F.array_sort(F.collect_set("sample")).alias("file_samples"))


def with_supplement(docs: DataFrame) -> DataFrame:
    """docs: folder, stem, text, is_supplement. Articles with supplement_text: of a supplement whose name begins with theirs, else of
    any in their folder; the first by name. An equi-join on the folder, the best match an aggregate."""
    articles, others = docs.where("not is_supplement"), docs.where("is_supplement").select("folder", F.col("stem").alias("_s"), F.col("text").alias("_t"))
    ranked = articles.select("folder", "stem").join(others, "folder").withColumn("_rank", F.when(F.col("_s").startswith(F.col("stem")), 0).otherwise(1))
    best = ranked.groupBy("folder", "stem").agg(F.min_by("_t", F.struct("_rank", "_s")).alias("supplement_text"))
    return articles.join(best, ["folder", "stem"], "left")


def page_of(pages: DataFrame, places: DataFrame) -> DataFrame:
    """path, place, page: the page that holds a place of the text in which pages are joined by two line feeds.

    pages: path, page, text; places: path, place (0-based).
    """
    by = Window.partitionBy("path").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    ends = pages.withColumn("_end", F.sum(F.length("text") + 2).over(by)).select("path", "page", "_end", (F.col("_end") - F.length("text") - 2).alias("_begin"))
    return places.join(ends, "path").where("place >= _begin and place < _end").select("path", "place", "page")


def write_report(rows: DataFrame, path: str) -> None:
    """One JSON document for each row: features, probabilities, neighbours or statistics, as they are."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)

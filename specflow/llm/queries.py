"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, divergence, langid, main_text, negatives, quality, simhash, suffix_dedup, token_counts, token_files, toxicity, urls
from .common import table
from .oracles import ORACLES


def fold(n: int) -> Column:
    """crc32 of the document's id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold(3) != 1))
    held_out = F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold(4) != 2))
    held_out = F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out")
    return langid.predict(docs, model).select("doc_id", held_out, "lang_pred", "score")


#: Rules of the URL query.
RULES = [urls.Rule.parse(*r) for r in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))]


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """A page shows the document whose number ends its path: it is bad if that is of low quality or toxic."""
    number = F.regexp_extract(urls.host_and_path(F.col("url"))[1], r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1).try_cast("bigint")
    marks = labels.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    return pages.select("page_id", number.alias("doc_id")).join(marks, "doc_id").select("page_id", "bad")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, page_labels(pages, table(spark, sf_dir, "labels")), RULES)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_links(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.quality(docs).drop("text", "lang").withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text.extract(pages, main_text.fit(pages))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_token_files, op3_suffix_dedup, op4_language_id, op5_url_filters, op6_token_counts, op7_decontaminate, op8_simhash, op9_quality_rules, op10_byte_bpe, op11_hard_negatives, op12_source_divergence, op13_main_text)}
__all__ = ["ORACLES", "QUERIES"]

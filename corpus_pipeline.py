"""The corpus pipeline: quality rules, near-dedup, exact substring dedup, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir), docs being all that the stage before it kept, and returns the columns of documents,
the last one the encoded documents. Nulls are allowed in any column: a null text counts as empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specflow.llm import byte_bpe, decontaminate, quality, simhash, suffix_dedup
from specflow.llm.common import release, scratch, scratches, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that are elsewhere too; n_chars follows."""
    out = suffix_dedup.remove(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, checksums, and the token ids."""
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("decontamination", decontamination),
    ("byte-level BPE", encoding),
]
#: SQL has no XXH64, suffix sorting or BPE: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage's rows are written to the shared folder and read by the next. What a stage
    wrote for itself goes when its rows are there, the rows when the next stage's are; those that the result is made of stay until
    the application ends, or until ``release``."""
    docs, before = table(spark, sf_dir, "documents"), scratches(spark)
    for name, stage in STAGES[:-1]:
        at = scratch(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(at)
        release(spark, {x for x in scratches(spark) - before if not x.endswith(at.rsplit("/", 1)[1])})
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)

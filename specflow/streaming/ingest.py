"""Curve files as a stream: each micro-batch of new files is analysed by the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import curves
from ..sources import curves as source


def file_stream(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    files = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", files_per_batch).text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    return files.select(path.alias("path"), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1).alias("stem"), F.col("value").alias("content"))


def features_to(spark: SparkSession, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the features of each batch to its own folder, which a repeated batch overwrites."""

    def batch(files: DataFrame, number: int) -> None:
        points = source.spectra(source.with_kind(source.parse_points(files)))
        named = points.withColumn("sample_id", F.concat_ws("/", "folder", source.sample_name(F.col("stem"))))
        curves.features(named).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return file_stream(spark, root).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""From a folder of curve files to a clustered feature table, in one session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters, curves
from ..sources import curves as source


def feature_table(spark: SparkSession, root: str, exponent: float = 0.5) -> DataFrame:
    """Features of every preferred file below ``root``; folders with a calibrator have its offset taken off."""
    files = source.preferred(source.read_files(spark, root))
    points = source.spectra(source.with_kind(source.parse_points(files)), exponent)
    known = source.calibrators(files)
    calibration = points.join(known.select(F.col("path")), "path", "left_semi").select("folder", "energy", "absorbance")
    found = curves.deltas(calibration, known.select("folder", "known_gap"), exponent)
    rest = points.join(known.select("path"), "path", "left_anti").withColumn("sample_id", F.concat_ws("/", "folder", source.sample_name(F.col("stem")))).withColumn("from_tauc", F.col("kind") == "tauc")
    return curves.features(curves.with_deltas(rest, found)).withColumn("folder", F.substring_index("sample_id", "/", 1)).withColumn("sample", F.substring_index("sample_id", "/", -1))


def run(spark: SparkSession, root: str, out: str, k: int | None = None) -> DataFrame:
    """Writes features and clusters below ``out`` and returns the clustered table."""
    features = feature_table(spark, root)
    source.write_features(features, out)
    stored = spark.read.parquet(f"{out}/features").where("status = 'ok'")
    clustered = clusters.nested(stored, k=k)
    clustered.write.parquet(f"{out}/clustered")
    return spark.read.parquet(f"{out}/clustered")


def write_tables(tables: dict[str, DataFrame], out: str) -> None:
    """Downstream tables (transitions, geometry, articles and so on), each as CSV with a header in a folder of its name below ``out``."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").option("header", True).csv(f"{out}/{name}")

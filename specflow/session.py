"""What a session needs for this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers started from now on import the package from where it is; elsewhere it must be shipped."""
    root, environment = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a local session that has none gets one, below its warehouse; on a cluster that
    would be one machine's own folder."""
    own, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not own and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors reach")
    own = own or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(own)
    return own.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as written to the shared folder: lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def on_disk(spark: SparkSession, at: str):
    """A path's file system and the path, as Spark itself reaches it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def moved(spark: SparkSession, source: str, target: str) -> bool:
    """Gives a folder its final name in one step; where that name is taken nothing changes, the source goes, and the answer is False."""
    java = spark._jvm.org.apache.hadoop.fs
    files, path = on_disk(spark, source)
    kind = java.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.NONE
    try:
        java.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(path, java.Path(target), how)
    except Exception as e:
        if "FileAlreadyExists" not in str(e):
            raise
        files.delete(path, True)
        return False
    return True

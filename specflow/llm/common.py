"""What the operators share: reading tables, the shared folder, Arrow batches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable

#: Bytes in one Arrow batch between the JVM and Python: what a worker holds at once follows this, not the row count.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of long texts small, and lets Python workers import this package."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors reach, as the session's ``spark.checkpoint.dir`` names it.

    Only a local session that has none gets one, below its warehouse; a Spark context checkpoints there too. On a cluster such a
    folder would be one machine's own, so a session without the setting is refused.
    """
    own, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not own and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors reach")
    own = own or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(own)
    return own.rstrip("/")


def _on_disk(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def run_dir(spark: SparkSession) -> str:
    """The part of the shared folder that is this application's own; it goes when the driver's JVM ends, or with ``release``."""
    at = f"{shared_dir(spark)}/run-{spark.sparkContext.applicationId}"
    files, path = _on_disk(spark, at)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return at


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the application's part of the shared folder."""
    return f"{run_dir(spark)}/{what}-{uuid.uuid4().hex}"


def scratches(spark: SparkSession) -> set[str]:
    """All that the application has in its part of the shared folder."""
    files, path = _on_disk(spark, run_dir(spark))
    return {str(x.getPath().toString()) for x in files.listStatus(path)}


def release(spark: SparkSession, paths: set[str] | None = None) -> None:
    """Deletes these of the application's scratch folders, or all: rows that were not written elsewhere can't be read again."""
    for at in scratches(spark) if paths is None else paths:
        files, path = _on_disk(spark, at)
        files.delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as written to the shared folder: lineage ends here and no executor's disk is needed to read them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def sampled(df: DataFrame, rows: int, total: int, *columns: str) -> DataFrame:
    """About ``rows`` of the ``total`` rows, by a hash of these columns: the same ones each time, found where they are."""
    return df if total <= rows else df.where(F.pmod(F.xxhash64(*columns), F.lit(1 << 31)) < int(rows / total * (1 << 31)))


def column(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def doubled(df: DataFrame, hashes: str, most: int) -> DataFrame:
    """hashes: a column with an array of the hashes of single words. Adds the hashes of all windows of 2, 4, 8, ... words, up to
    ``most``, each from two of half its length; ``window_hash`` makes those of other lengths from these."""
    n = 1
    while 2 * n <= most:
        half = _runs(hashes, n)
        df = df.withColumn(_runs(hashes, 2 * n), F.zip_with(half, F.slice(half, n + 1, F.greatest(F.lit(0), F.size(half) - n)), lambda x, y: F.xxhash64(x, y)))
        n *= 2
    return df


def _runs(hashes: str, n: int) -> str:
    return hashes if n == 1 else f"{hashes}_{n}"


def window_hash(hashes: str, n: int) -> Column:
    """The hashes of a text's windows of n words in their order, an empty array if it has fewer words."""
    count, at, out = F.greatest(F.lit(0), F.size(hashes) - (n - 1)), 0, None
    for bit in reversed(range(n.bit_length())):
        if n >> bit & 1:
            part = F.slice(_runs(hashes, 1 << bit), at + 1, count)
            out = part if out is None else F.zip_with(out, part, lambda x, y: F.xxhash64(x, y))
            at += 1 << bit
    return out


def slices(texts, most: int = 4 << 20):
    """Runs (begin, end) of a list of texts with about ``most`` characters each, one text at least."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)

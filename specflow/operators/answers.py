"""Answers of a language model to prompts: a table that grows batch by batch, which a killed run goes on with.

Articles without an answer are dealt into batches by the order of their ids. A batch is a job of its own: tasks ask one prompt at a time,
pausing in between, and try again what failed; its rows are then committed as one folder, named by the batch's content, that takes its
place in one move. What is there is never asked for again, so a run that was stopped asks for the rest only; and as a batch's name
follows from its articles, a repeated commit of it changes nothing. The calls of a batch that was not committed are lost with it: that is
what ``batch`` bounds.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, moved, on_disk
from .order import numbered
from .tags import unprocessed

SCHEMA = "article_id string, config_version string, response string, status string, error string, tries int"
#: Articles that are committed together, seconds between calls of a task, and tries of a call.
BATCH, PAUSE, TRIES = 5, 1.0, 3


def read(spark: SparkSession, at: str) -> DataFrame:
    """The committed answers, one of each article, a success if it has one."""
    files, path = on_disk(spark, at)
    done = [x.getPath().toString() for x in files.listStatus(path) if x.isDirectory() and x.getPath().getName().startswith("batch-")] if files.exists(path) else []
    if not done:
        return spark.createDataFrame([], SCHEMA)
    every = spark.read.schema(SCHEMA).parquet(*done)
    best = F.max_by(F.struct(*(c for c in every.columns if c != "article_id")), F.struct((F.col("status") == "success").alias("s"), F.col("response").alias("r")))
    return every.groupBy("article_id").agg(best.alias("x")).select("article_id", "x.*")


def asked(articles: DataFrame, client, version: str, prompt: str, *, pause: float = PAUSE, tries: int = TRIES, wait: float = 1.0) -> DataFrame:
    """article_id, prompt of one batch become answers. client: makes, on the worker, a callable that maps a prompt to JSON text. A call
    that fails is tried again after ``wait`` seconds, then twice as many; after the last one the row tells the error."""

    def run(batches):
        import pandas as pd

        ask, begun = client(), False
        for batch in batches:
            rows = []
            for article, p in zip(batch["article_id"], batch[prompt], strict=True):
                for n in range(1, tries + 1):
                    if begun and pause:
                        time.sleep(pause)
                    begun = True
                    try:
                        rows.append((article, version, ask(p), "success", None, n))
                        break
                    except Exception as e:  # noqa: BLE001  (any failure of a client is a row's status)
                        if n == tries:
                            rows.append((article, version, None, "error", str(e), n))
                        elif wait:
                            time.sleep(wait * 2 ** (n - 1))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return articles.select("article_id", prompt).mapInPandas(run, SCHEMA)


def answer(articles: DataFrame, client, prompt: str, at: str, *, version: str, batch: int = BATCH, tasks: int = 1, again: bool = False, **pacing) -> DataFrame:
    """The answers of all ``articles`` (article_id, prompt), committed below ``at``, a folder that all machines reach. Ids repeat or are
    null: one row of an id is asked for, none without one. ``again`` asks once more for what ended in an error; answers of another version
    stop the run. ``tasks`` ask at the same time, so calls come at up to tasks / pause a second."""
    spark = articles.sparkSession
    done = read(spark, at)
    left = unprocessed(articles.where("article_id is not null"), done.where("status = 'success'") if again else done, version) if done.limit(1).count() else articles.where("article_id is not null")
    left = numbered(left.groupBy("article_id").agg(F.min(prompt).alias(prompt)), "article_id", "_place").withColumn("_batch", F.floor((F.col("_place") - 1) / batch))
    left = checkpointed(left)
    last = left.agg(F.max("_batch")).first()[0]
    for b in range(0 if last is None else last + 1):
        rows = left.where(F.col("_batch") == b)
        ids = rows.agg(F.md5(F.concat_ws("\n", F.array_sort(F.collect_list("article_id")))).alias("h")).first()["h"]  # of ``batch`` ids
        name = f"batch-{version}-{ids}" + ("-again" if again else "")
        made = f"{at}/_making-{name}-{uuid.uuid4().hex}"
        asked(rows.repartition(tasks, "article_id"), client, version, prompt, **pacing).write.parquet(made)
        moved(spark, made, f"{at}/{name}")  # if it is there, another run was faster
    return read(spark, at)

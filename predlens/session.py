"""Session settings and lineage cuts shared by all jobs."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on; a cluster's own spark-defaults stay in force for the rest.
JOB_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str = "predlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the job settings; ``master`` is only given for local runs."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for name, value in {**JOB_CONF, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def durable(df: DataFrame, name: str = "rows") -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder and read it back.

    Parquet rather than a checkpoint, so that readers of few columns still read few. What
    is lost with an executor is read again, not computed again.
    """
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, task_rows: int, *keys: str) -> DataFrame:
    """The rows in tasks of some ``task_rows``, by the hash of ``keys`` if any are given.

    A file of narrow rows is a task or two, and what a task keeps of each row may be many times as
    large. Counts ``df``, so it should be a table or a frame that is kept.
    """
    tasks = math.ceil(df.count() / task_rows)
    return df.repartition(tasks, *keys) if tasks > 1 else df


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files a job writes and reads back, below the shared checkpoint folder.

    Only a local master without that setting uses a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can read")
        return tempfile.mkdtemp(prefix=f"predlens-{name}-") + "/data"
    return f"{root.rstrip('/')}/predlens-{name}-{uuid.uuid4().hex}"

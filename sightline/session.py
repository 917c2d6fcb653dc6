"""Session settings and the shared scratch location."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app_name: str = "sightline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the page jobs are tuned for.

    Pages are wide rows, so fewer of them travel in each Arrow batch. Everything else is left
    to adaptive execution: partition coalescing and skew splitting are on.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of its own; on a cluster the
    setting has to be there, because executors on other machines read what is written.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="sightline-")
    atexit.register(shutil.rmtree, root, True)
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared scratch folder."""
    return f"{scratch_root(spark).rstrip('/')}/sightline/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage of iterative jobs and lets several consumers share one computation; the
    files outlive the loss of any executor.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcastable(df: DataFrame, rows: int = 100_000) -> bool:
    """Whether ``df`` has at most ``rows`` rows; looks at no more than one beyond that."""
    return df.limit(rows + 1).count() <= rows

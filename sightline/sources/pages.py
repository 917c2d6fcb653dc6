"""Where pages come from: a table of fetched pages, or HTML files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sightline.functions.text import lit
from sightline.functions.urls import netloc


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table of fetched pages (``page_id, url, html``)."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """Local or shared HTML files as pages; the URL is the file's path."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("url"), F.col("value").alias("html")
    )
    return files.select(F.xxhash64("url").alias("page_id"), "url", "html")


def with_site(pages: DataFrame) -> DataFrame:
    """Add ``site``, the authority of the page's URL."""
    return pages.withColumn("site", F.expr(netloc("url")))


def fetch_outcomes(log: DataFrame, attempts: int) -> DataFrame:
    """What became of each fetch attempt (``url, attempt, status, error``).

    Timeouts and connection errors are tried again, up to ``attempts`` times; other failures are final.
    """
    retryable = "error IN ('timeout', 'connect', 'read')"
    return log.withColumn("outcome", F.expr(
        f"CASE WHEN {retryable} AND attempt < {attempts} THEN {lit('retry')} "
        f"WHEN error IS NOT NULL THEN {lit('failed')} "
        "WHEN status BETWEEN 200 AND 299 THEN 'ok' "
        "WHEN status BETWEEN 400 AND 499 AND status <> 429 THEN 'empty' "
        "ELSE 'failed' END"
    ))

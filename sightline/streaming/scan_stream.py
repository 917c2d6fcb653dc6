"""Scanning pages as they arrive.

All rules are local to a page, so the streaming scan is the batch plan without any state: it can append
to the history exactly once and its tasks share nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sightline.plans.scan import count_pages, scan_pages
from sightline.sources.history import append_scan_results, scan_results

PAGES = "page_id bigint, url string, html string"


def stream_pages(spark: SparkSession, folder: str, *, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Pages of parquet files as they appear in a folder."""
    reader = spark.readStream.schema(PAGES).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def stream_history(pages: DataFrame, path: str, checkpoint: str, ts: int | None = None, **trigger) -> StreamingQuery:
    """Scan a stream of pages and append the results to the history table.

    Every micro-batch is a batch of the store under a name made from the checkpoint and its number, so one that is repeated
    after a failure replaces itself, and batch jobs may append to the same store.
    """
    rows = scan_results(scan_pages(pages), ts)
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:16]

    def append(batch: DataFrame, number: int) -> None:
        append_scan_results(batch, path, f"{stream}-{number:010d}")

    return (
        rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    )


def first_sightings(pages: DataFrame, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each address once, at its first arrival.

    With an event time the state only reaches back ``delay``; without one it keeps every address.
    """
    if event_time:
        return pages.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["url"])
    return pages.dropDuplicates(["url"])


def running_severity_counts(pages: DataFrame) -> DataFrame:
    """Pages and issues by severity per site, growing as pages arrive (update or complete mode)."""
    scanned = count_pages(pages)
    return scanned.groupBy("site").agg(
        F.count("*").alias("pages"),
        F.sum("total").alias("issues"),
        *[F.sum(name).alias(name) for name in ("critical", "major", "minor")],
    )

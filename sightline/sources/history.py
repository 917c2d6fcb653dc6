"""Scan history: an append-only table of results per site and page.

The store has one folder per appended batch and in it at most ``BUCKETS`` folders by a hash of the site, however many sites
there are. A batch that is written again replaces itself, so repeated tasks and micro-batches change nothing; batch jobs and
streams append to the same store.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

BUCKETS = 64
SCANS = "site string, url string, issues_json string, ts bigint"
STORED = SCANS + ", batch string, bucket int"
ISSUES = (
    "array<struct<code:string,message:string,context:string,analyzer:string,severity:string,"
    "wcag:string,wcag_name:string,impact:string>>"
)


def init_scan_store(spark: SparkSession, path: str) -> None:
    """Create an empty store unless there is one; what is stored stays."""
    spark.createDataFrame([], STORED).write.mode("ignore").partitionBy("batch", "bucket").parquet(path)


def scan_results(pages: DataFrame, ts: int | None = None) -> DataFrame:
    """History rows of scanned pages; ``ts`` defaults to now, in seconds."""
    fields = ["code", "message", "context", "analyzer"]
    if "severity" in pages.schema["issues"].dataType.elementType.names:
        fields += ["severity", "wcag", "wcag_name", "impact"]
    issues = f"transform(issues, i -> struct({', '.join(f'i.{name}' for name in fields)}))"
    when = F.unix_timestamp() if ts is None else F.lit(ts).cast("bigint")
    return pages.select("site", "url", F.expr(f"to_json({issues})").alias("issues_json"), when.alias("ts"))


def _bucket(site):
    return F.pmod(F.xxhash64(site), F.lit(BUCKETS)).cast("int")


def append_scan_results(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Append history rows as one batch; one of the same name is replaced.

    Rows are rebalanced by bucket, which gathers small sites in few files and lets adaptive execution split a big one; sorting
    lets the statistics in the files tell sites apart.
    """
    stored = rows.select("site", "url", "issues_json", "ts").withColumn("bucket", _bucket("site"))
    stored.hint("rebalance", "bucket").sortWithinPartitions("bucket", "site", "url").write.mode("overwrite").partitionBy(
        "bucket"
    ).parquet(f"{path}/batch={batch or uuid.uuid4().hex}")


def read_scan_history(spark: SparkSession, path: str, site: str | None = None) -> DataFrame:
    """Stored results, newest first, issues decoded; one site reads only its bucket."""
    rows = spark.read.schema(STORED).parquet(path)
    if site is not None:
        rows = rows.where((F.col("site") == site) & (F.col("bucket") == _bucket(F.lit(site))))
    return decoded(rows)


def decoded(rows: DataFrame) -> DataFrame:
    """Newest first. Issues are decoded after the sort, which then moves text and not nested lists."""
    ordered = rows.orderBy(F.desc("ts"), "url")
    return ordered.select("site", "url", F.from_json("issues_json", ISSUES).alias("issues"), "ts")

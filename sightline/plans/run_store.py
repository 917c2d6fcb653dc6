"""A store of scan runs: requests are served in batches, and what happens to them is written down when it happens.

The store has the event log of ``sources.runs`` and the results of the runs, one row per scanned page with its issues. Both
have a folder per batch, and results at most ``BUCKETS`` folders by a hash of the run in it, so reading one run reads
one bucket of every batch. A batch that is served again under its name replaces itself, log and results; so a repeated micro-batch
of requests neither doubles a run nor leaves the error of its first try behind.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sightline import vocab
from sightline.functions.urls import without_fragment
from sightline.operators.rules import RuleSet
from sightline.plans.crawl import scan_visits
from sightline.plans.requests import FIELDS, scan_site_requests, with_scan_ids
from sightline.plans.scan import scan_pages
from sightline.session import broadcastable, materialize
from sightline.sources.history import ISSUES
from sightline.sources.runs import EVENTS, get_run

BUCKETS = 64
RESULTS = f"scan_id string, rank bigint, url string, issues {ISSUES}, total int, critical int, major int, minor int"
COUNTS = ("total", "critical", "major", "minor")
SHOWN = "transform(issues, i -> struct(i.code, i.message, i.context, i.analyzer, i.severity, i.wcag, i.wcag_name, i.impact))"
OPTIONS = {"scan_site": "boolean", "max_pages": "int", "exclude_analyzers": "array<string>"}


def _now() -> datetime:
    return datetime.now(timezone.utc)


def _bucket(scan_id):
    return F.pmod(F.xxhash64(scan_id), F.lit(BUCKETS)).cast("int")


def _log(runs: DataFrame, path: str, batch: str, part: str, status, moment: datetime | None = None, **fields) -> None:
    """Write one event per run. No event is dated before the request it follows, should clocks differ."""
    at = F.col("requested_at") if moment is None else F.greatest(F.lit(moment).cast("timestamp"), F.col("requested_at"))
    values = {name: fields.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in FIELDS.items()}
    names = [field.split()[0] for field in EVENTS.split(", ")]
    made = runs.select("scan_id", at.cast("timestamp").alias("event_time"), status.alias("status"), *values.values())
    made.select(*names).write.mode("overwrite").parquet(f"{path}/events/batch={batch}/part={part}")


def _page_results(pages: DataFrame, wanted: DataFrame, rules: RuleSet | None) -> DataFrame:
    """Results of requests for single pages.

    All other pages are dropped before they are parsed, which takes far longer than moving them: by a broadcast while the
    requested addresses are few (counted), by a shuffle beyond that. Only issues are joined to requests, never markup. Of
    several fetches of an address the latest counts; an empty page was not fetched.
    """
    wanted = wanted.withColumn("address", F.expr(without_fragment("url")))
    asked = wanted.select("address").distinct()
    sources = pages.where("html <> ''").withColumn("address", F.expr(without_fragment("url")))
    sources = sources.join(F.broadcast(asked) if broadcastable(asked) else asked, "address", "left_semi")
    index = scan_pages(sources, rules=rules).groupBy("address").agg(
        F.expr("max_by(struct(page_id, issues), page_id) AS found")
    ).select("address", "found.*")
    visits = wanted.selectExpr(
        "scan_id AS request", "url", "1L AS rank", "'ok' AS outcome", "exclude_analyzers AS exclude",
    )
    return scan_visits(index, visits).where("page_id IS NOT NULL")


def serve_requests(
    pages: DataFrame,
    requests: DataFrame,
    path: str,
    batch: str | None = None,
    *,
    rules: RuleSet | None = None,
    exclude: Iterable[str] = (),
    max_pages: int | None = vocab.CRAWL_MAX_PAGES,
    robots: DataFrame | None = None,
    sitemap: DataFrame | None = None,
) -> None:
    """Run every valid request of a batch against the snapshot and store log and results under ``path``.

    Requests have ``url, requested_at`` and may have ``request_key``, ``scan_site`` (false: the page alone), ``max_pages`` (of a
    site) and ``exclude_analyzers``; nulls mean the default. Rejected requests leave nothing; equal ones are one run. A run
    is pending from its request, running from when its batch is taken up, and completed once its results are stored; without
    a fetched page it fails. If the job itself fails, its runs are logged as failed with the reason, and the error is raised.
    """
    batch = batch or uuid.uuid4().hex
    given = [name for name in OPTIONS if name in requests.columns]
    filled = requests.withColumns({name: F.lit(None).cast(kind) for name, kind in OPTIONS.items() if name not in given})
    skipped = F.array(*map(F.lit, exclude)).cast("array<string>")
    accepted = with_scan_ids(filled).where("valid").dropDuplicates(["scan_id"]).withColumns({
        "scan_site": F.coalesce("scan_site", F.lit(False)),
        "max_pages": F.coalesce("max_pages", F.lit(max_pages).cast("int")),
        "exclude_analyzers": F.concat(skipped, F.coalesce("exclude_analyzers", F.array().cast("array<string>"))),
    })
    accepted = materialize(accepted.select("scan_id", "url", "requested_at", "valid", *OPTIONS), "requests")
    _log(accepted, path, batch, "pending", F.lit("pending"), url=F.col("url"))
    started = _now()
    _log(accepted, path, batch, "running", F.lit("running"), started, started_at=F.lit(started))
    folder = f"{path}/results/batch={batch}"
    try:
        single = _page_results(pages, accepted.where("NOT scan_site"), rules)
        sites = accepted.where("scan_site")
        columns = ["request AS scan_id", "rank", "url", f"{SHOWN} AS issues", *(f"cast({c} AS INT) AS {c}" for c in COUNTS)]
        found = single.selectExpr(*columns)
        if not sites.isEmpty():
            visits = scan_site_requests(pages, sites, max_pages=max_pages, robots=robots, sitemap=sitemap, rules=rules)
            found = found.unionByName(visits.where("outcome = 'ok'").selectExpr(*columns))
        found.withColumn("bucket", _bucket(F.col("scan_id"))).hint("rebalance", "bucket").sortWithinPartitions(
            "bucket", "scan_id", "rank"
        ).write.mode("overwrite").partitionBy("bucket").parquet(folder)
    except Exception as problem:
        failed = _now()
        reason = F.lit(f"{type(problem).__name__}: {problem}"[:2000])
        _log(accepted, path, batch, "ended", F.lit("failed"), failed, completed_at=F.lit(failed), error=reason)
        raise
    stored = pages.sparkSession.read.schema(f"{RESULTS}, bucket int").parquet(folder)
    counted = stored.groupBy("scan_id").agg(F.count("*").alias("pages"), F.sum("total").alias("found"))
    ended = _now()
    joined = accepted.join(counted, "scan_id", "left")
    done = F.col("pages").isNotNull()
    _log(
        joined, path, batch, "ended", F.when(done, "completed").otherwise("failed"), ended, completed_at=F.lit(ended),
        pages_scanned=F.col("pages"), total_issues=F.col("found"), error=F.when(~done, "page not found"),
    )


def serve_stream(pages: DataFrame, requests: DataFrame, path: str, checkpoint: str, *, trigger: dict | None = None, **options) -> StreamingQuery:
    """Serve a stream of requests, one batch of the store per micro-batch."""
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:16]

    def serve(rows: DataFrame, number: int) -> None:
        serve_requests(pages, rows, path, f"{stream}-{number:010d}", **options)

    return (
        requests.writeStream.foreachBatch(serve).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event log of the store."""
    return spark.read.schema(f"{EVENTS}, batch string, part string").parquet(f"{path}/events").drop("batch", "part")


def read_results(spark: SparkSession, path: str, scan_id: str | None = None) -> DataFrame:
    """A row per run and scanned page: ``scan_id, rank, url, issues`` and counts. One run reads only its bucket and must be known."""
    stored = spark.read.schema(f"{RESULTS}, batch string, bucket int").parquet(f"{path}/results")
    if scan_id is not None:
        get_run(read_events(spark, path), scan_id)
        stored = stored.where((F.col("scan_id") == scan_id) & (F.col("bucket") == _bucket(F.lit(scan_id))))
    return stored.drop("batch", "bucket")


def run_summaries(results: DataFrame) -> DataFrame:
    """Pages, issues and issues by severity of every run."""
    return results.groupBy("scan_id").agg(
        F.count("*").alias("total_pages"), F.sum("total").alias("total_issues"),
        *(F.sum(name).alias(name) for name in COUNTS[1:]),
    )

"""Scan requests: from a table of requested addresses to the log of their runs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from sightline.functions.urls import netloc, valid_scan_url, without_fragment
from sightline.operators.rules import RuleSet
from sightline.plans.crawl import scan_sites
from sightline.plans.scan import count_pages
from sightline.sources.runs import EVENTS
from sightline.vocab import CRAWL_MAX_PAGES

FIELDS = {
    "url": "string", "pages_scanned": "int", "total_issues": "int", "started_at": "timestamp",
    "completed_at": "timestamp", "error": "string",
}


def with_scan_ids(requests: DataFrame) -> DataFrame:
    """Requests (``url, requested_at``, and ``request_key`` where given) with ``valid`` and the ``scan_id`` of their run.

    The id is made from address, time and key, so that a task that is run again makes the same one. Only the key tells
    requests for one address in one moment apart.
    """
    key = ", request_key" if "request_key" in requests.columns else ""
    digest = f"md5(concat_ws('|', url, requested_at{key}))"
    shape = r"'^(.{8})(.{4})(.{4})(.{4})(.{12})$', '$1-$2-$3-$4-$5'"
    return requests.selectExpr(
        "*", f"{valid_scan_url('url')} AS valid", f"regexp_replace({digest}, {shape}) AS scan_id"
    )


def _event(status: str, at: str, **fields: str) -> str:
    values = ", ".join(f"cast({fields.get(name, 'NULL')} AS {kind}) AS {name}" for name, kind in FIELDS.items())
    return f"struct({at} AS event_time, '{status}' AS status, {values})"


def run_page_requests(
    pages: DataFrame, requests: DataFrame, rules: RuleSet | None = None, exclude: Iterable[str] = ()
) -> DataFrame:
    """Run every valid request for a single page against the snapshot; returns the event log of the runs.

    A request for a page the snapshot lacks fails. Rejected requests leave no events. Issues are counted
    where the pages are read; only addresses and counts are joined to the requests.
    """
    accepted = requests.where("valid").withColumn("address", F.expr(without_fragment("url")))
    scanned = count_pages(pages, rules=rules, exclude=exclude)
    counted = scanned.groupBy(F.expr(without_fragment("url")).alias("address")).agg(
        F.max_by("total", "page_id").alias("found")
    )
    return _run_events(accepted.join(counted.withColumn("pages", F.lit(1)), "address", "left"))


def scan_site_requests(
    pages: DataFrame,
    requests: DataFrame,
    *,
    max_pages: int | None = CRAWL_MAX_PAGES,
    robots: DataFrame | None = None,
    sitemap: DataFrame | None = None,
    rules: RuleSet | None = None,
    exclude: Iterable[str] = (),
) -> DataFrame:
    """The visits of every valid request for a whole site, with what was found; ``request`` is the id of the run.

    Every request is a crawl of its own, from its own address, under its own ``max_pages`` and without the rules in its own
    ``exclude_analyzers``, where the requests have these columns; all share one parse of the pages.
    """
    options = ["max_pages"] if "max_pages" in requests.columns else []
    skipped = ["exclude_analyzers AS exclude"] if "exclude_analyzers" in requests.columns else []
    seeds = requests.where("valid").selectExpr("scan_id AS request", f"{netloc('url')} AS site", "url", *options, *skipped)
    return scan_sites(pages, seeds, rules=rules, exclude=exclude, max_pages=max_pages, robots=robots, sitemap=sitemap)


def run_site_requests(pages: DataFrame, requests: DataFrame, **options) -> DataFrame:
    """Run every valid request for a whole site (``scan_site_requests``); returns the event log."""
    counted = scan_site_requests(pages, requests, **options).groupBy(F.col("request").alias("scan_id")).agg(
        F.sum("total").alias("found"), F.count("*").alias("pages")
    )
    return _run_events(requests.where("valid").join(counted, "scan_id", "left"))


def _run_events(joined: DataFrame) -> DataFrame:
    """The events of runs that found ``found`` issues on ``pages`` pages, or nothing at all."""
    start, end = "requested_at + INTERVAL 1 SECOND", "requested_at + INTERVAL 2 SECONDS"
    done = (
        f"CASE WHEN found IS NULL THEN {_event('failed', end, completed_at=end, error=repr('page not found'))} "
        f"ELSE {_event('completed', end, completed_at=end, pages_scanned='pages', total_issues='found')} END"
    )
    events = f"array({_event('pending', 'requested_at', url='url')}, {_event('running', start, started_at=start)}, {done})"
    names = [field.split()[0] for field in EVENTS.split(", ")]
    return joined.selectExpr("scan_id", f"explode({events}) AS e").select("scan_id", "e.*").select(*names)

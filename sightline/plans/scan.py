"""A scan from pages to issues and counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from sightline.operators.dom import with_dom
from sightline.operators.rules import RuleSet, issue_rows, page_issues, page_totals
from sightline.operators.summaries import severity_totals, with_severity
from sightline.sources.pages import with_site


def scan_pages(
    pages: DataFrame, *, rules: RuleSet | None = None, exclude: Iterable[str] = (), markup: bool = True
) -> DataFrame:
    """One row per page: its enriched ``issues`` in report order, and ``total, critical, major, minor``.

    Reading, parsing, checking and counting a page all happen in the task that read it. ``markup=False``
    leaves contexts out, for scans that only count.
    """
    sited = pages if "site" in pages.columns else with_site(pages)
    return with_severity(page_issues(with_dom(sited, markup=markup), rules, exclude))


def scan_issues(pages: DataFrame, *, rules: RuleSet | None = None, exclude: Iterable[str] = ()) -> DataFrame:
    """One row per issue, before enrichment."""
    return issue_rows(page_issues(with_dom(pages), rules, exclude))


def count_pages(pages: DataFrame, *, rules: RuleSet | None = None, exclude: Iterable[str] = ()) -> DataFrame:
    """One row per page with ``total, critical, major, minor``, for scans that only count."""
    sited = pages if "site" in pages.columns else with_site(pages)
    return page_totals(with_dom(sited, markup=False), rules, exclude)


def site_severity_summary(pages: DataFrame) -> DataFrame:
    """Pages, issues and severity counts per site; the shuffle carries one row per site and task."""
    return severity_totals(count_pages(pages), "site")

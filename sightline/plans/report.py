"""Reports as tables: overview, details, headers, console lines, and report files.

All take the output of ``scan_pages``. A sorted report reads its input twice (once to find the ranges), and
several reports read it several times: keep the scan with ``materialize`` first.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sightline import vocab
from sightline.functions import severity as S
from sightline.functions.text import anchor_id, html_escape, lit
from sightline.operators.summaries import nested_report, severity_totals
from sightline.session import materialize

DEFAULT_TITLE = "Accessibility Report"

# Issues of a page as the report lists them: critical first, otherwise as found.
LISTED = (
    f"array_sort(transform(issues, i -> struct({S.severity_rank('i.severity')} AS severity_rank, i.analyzer_ord, "
    "i.loop_ord, i.node_id, i.check_ord, i.code, i.message, i.context, i.severity, i.wcag)))"
)
CHART = "format_string('{\"critical\": %d, \"major\": %d, \"minor\": %d}', critical, major, minor)"


def _cut(context: str) -> str:
    limit = vocab.REPORT_CONTEXT_CHARS
    dots = f"CASE WHEN length({context}) > {limit} THEN '...' ELSE '' END"
    return f"concat({html_escape(f'substring({context}, 1, {limit})')}, {dots})"


# One issue ``i`` of LISTED as it is shown.
SHOWN = (
    "struct(i.severity AS severity_class, "
    f"concat({S.severity_emoji('i.severity')}, ' ', upper(i.severity)) AS badge, "
    f"{html_escape("coalesce(i.code, 'UNKNOWN')")} AS code, "
    f"coalesce({html_escape("nullif(i.wcag, '')")}, '-') AS wcag, "
    f"{html_escape("coalesce(i.message, '')")} AS message, {_cut("coalesce(i.context, '')")} AS context)"
)


def page_overview(pages: DataFrame) -> DataFrame:
    """One row per page, most issues first; ties keep scan order."""
    return pages.selectExpr(
        "site", "page_id", "url", f"{anchor_id('url')} AS anchor", "total", "critical", "major", "minor",
        f"{S.status_class('total', 'critical')} AS status_class",
    ).orderBy("site", F.desc("total"), "page_id")


def issue_details(pages: DataFrame) -> DataFrame:
    """One row per issue as the detail section of its page shows it."""
    listed = pages.select("site", "page_id", "url", F.posexplode_outer(F.expr(f"transform({LISTED}, i -> {SHOWN})"))
                          .alias("place", "shown"))
    return listed.where("shown IS NOT NULL").selectExpr(
        "site", "page_id", "url", f"{anchor_id('url')} AS anchor", "place", "shown.*"
    )


def site_header(pages: DataFrame, generated: str, title: str | None = None, version: str = "1") -> DataFrame:
    """Title, totals and chart data of every site."""
    totals = severity_totals(pages, "site")
    return totals.selectExpr(
        "site", f"{html_escape(lit(title or DEFAULT_TITLE))} AS title", f"{lit(generated)} AS generated",
        f"{lit(version)} AS version", "pages AS total_pages", "issues AS total_issues", "critical", "major", "minor",
        f"{CHART} AS chart_data",
    )


def page_header(pages: DataFrame, generated: str, title: str | None = None, version: str = "1") -> DataFrame:
    """The same for a report on every single page."""
    return pages.selectExpr(
        "page_id", "url", f"{html_escape(lit(title or DEFAULT_TITLE))} AS title", f"{lit(generated)} AS generated",
        f"{lit(version)} AS version", "total AS total_issues", "critical", "major", "minor", f"{CHART} AS chart_data",
    )


def page_report(pages: DataFrame, url: str) -> DataFrame:
    """Details of one page."""
    return issue_details(pages.where(F.col("url") == url))


def console_pages(pages: DataFrame) -> DataFrame:
    """One status line per page, in scan order."""
    status = "CASE WHEN total = 0 THEN '✅' ELSE '⚠️' END"
    return pages.selectExpr(
        "page_id", f"concat('  ', {status}, ' ', url, ': ', total, ' issues') AS line"
    ).orderBy("page_id")


def top_issues(pages: DataFrame, limit: int = vocab.CONSOLE_ISSUES) -> DataFrame:
    """The first issues of the whole scan in severity order."""
    listed = pages.select("page_id", F.posexplode_outer(F.expr(LISTED)).alias("place", "i")).where("i IS NOT NULL")
    first = listed.orderBy("i.severity_rank", "page_id", "place").limit(limit)
    context = f"concat(substring(coalesce(i.context, ''), 1, {vocab.CONSOLE_CONTEXT_CHARS}), '...')"
    return first.selectExpr(
        "page_id", "place", f"{S.severity_emoji('i.severity')} AS emoji", "i.code AS code",
        "coalesce(i.wcag, '') AS wcag", "i.message AS message", f"{context} AS context",
    )


def issues_beyond(pages: DataFrame, limit: int = vocab.CONSOLE_ISSUES) -> DataFrame:
    """Totals of the whole scan, and how many issues ``top_issues`` leaves out."""
    return severity_totals(pages).selectExpr(
        "pages", "issues", "critical", "major", "minor", f"greatest(issues - {limit}, 0) AS more"
    )


def report_lines(pages: DataFrame, generated: str, title: str | None = None, version: str = "1") -> DataFrame:
    """The HTML report of every site as ordered lines (``site, part, weight, page_id, place, line``)."""
    url, anchor = html_escape("url"), anchor_id("url")
    head = site_header(pages, generated, title, version).selectExpr(
        "site", "0 AS part", "0 AS weight", "cast(0 AS BIGINT) AS page_id", "0 AS place",
        "concat('<!DOCTYPE html><html lang=\"en\"><head><meta charset=\"utf-8\"><title>', title, '</title></head>"
        "<body><main><h1>', title, '</h1><p>', generated, ' / ', version, '</p><p>', total_pages, ' pages, ', "
        "total_issues, ' issues: ', critical, ' critical, ', major, ' major, ', minor, ' minor</p>"
        "<script type=\"application/json\" id=\"chart\">', chart_data, '</script><table>') AS line",
    )
    foot = pages.select("site").distinct().selectExpr(
        "site", "3 AS part", "0 AS weight", "cast(0 AS BIGINT) AS page_id", "0 AS place", "'</main></body></html>' AS line"
    )
    row = (
        f"concat('<tr class=\"', {S.status_class('total', 'critical')}, '\"><td><a href=\"#', {anchor}, '\">', {url}, "
        "'</a></td><td>', total, '</td><td>', critical, '</td><td>', major, '</td><td>', minor, '</td></tr>')"
    )
    start = (
        f"concat('<section id=\"', {anchor}, '\"><h2><a href=\"', {url}, '\">', {url}, '</a> ', total, "
        "' issues</h2><table>')"
    )
    issue = (
        "concat('<tr class=\"severity-', s.severity_class, '\"><td>', s.badge, '</td><td><code>', s.code, "
        "'</code></td><td>', s.wcag, '</td><td>', s.message, '</td><td><code>', s.context, '</code></td></tr>')"
    )
    rows = f"transform(transform({LISTED}, i -> {SHOWN}), (s, n) -> struct(2 AS part, 0 AS weight, n + 1 AS place, {issue} AS line))"
    section = (
        f"CASE WHEN total = 0 THEN array() ELSE concat(array(struct(2 AS part, 0 AS weight, 0 AS place, {start} AS line)), "
        f"{rows}, array(struct(2 AS part, 0 AS weight, total + 1 AS place, '</table></section>' AS line))) END"
    )
    body = pages.selectExpr(
        "site", "page_id", f"concat(array(struct(1 AS part, -total AS weight, 0 AS place, {row} AS line)), {section}) AS lines"
    ).select("site", "page_id", F.explode("lines").alias("l")).selectExpr(
        "site", "l.part AS part", "l.weight AS weight", "page_id", "l.place AS place", "l.line AS line"
    )
    closing = pages.select("site").distinct().selectExpr(
        "site", "1 AS part", "1 AS weight", "cast(0 AS BIGINT) AS page_id", "0 AS place", "'</table>' AS line"
    )
    return head.unionByName(body).unionByName(closing).unionByName(foot)


def write_site_report(pages: DataFrame, path: str, generated: str, title: str | None = None, version: str = "1") -> None:
    """Write one folder of text files per site; read in name order they are the site's HTML report.

    The lines are range-partitioned, so a site of any size is spread over as many files as it needs.
    """
    lines = report_lines(materialize(pages, "report"), generated, title, version)
    order = ["site", "part", "weight", "page_id", "place"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("site", "line").write.partitionBy(
        "site"
    ).text(path)


def site_document(pages: DataFrame, fixed: DataFrame | None = None, version: str = "1") -> DataFrame:
    """The nested report of every site as ordered lines (``site, part, page_id, line``) that join to one JSON object.

    The first line opens ``pages``, a line per page in order of ``page_id`` holds its entry, the last one has the version and the
    site's counts. ``fixed`` (an output of ``apply_fixes`` for the same pages) adds what was fixed and the start of the new markup, or why
    not. A site is never gathered: lines are made in the row of their page, and only counts and the first page of a site are grouped.
    """
    nested = nested_report(pages, version)
    entry = "to_json(struct(issues, summary, severity_summary), map('ignoreNullFields', 'false'))"
    if fixed is not None:
        done = (
            "CASE WHEN fix_error IS NULL THEN to_json(struct(applied AS fixed_fixes, "
            f"substring(fixed_html, 1, {vocab.SNIPPET_CHARS}) AS fixed_html_snippet), map('ignoreNullFields', 'false')) "
            "ELSE to_json(struct(fix_error AS fixed_error)) END AS fix_entry"
        )
        nested = nested.join(fixed.selectExpr("page_id", done), "page_id", "left")
        entry = f"concat(substring({entry}, 1, length({entry}) - 1), coalesce(concat(',', substring(fix_entry, 2)), '}}'))"
    entries = nested.selectExpr("site", "1 AS part", "page_id", "to_json(named_struct('u', url)) AS name", f"{entry} AS entry")
    first = pages.groupBy("site").agg(F.min("page_id").alias("page_id")).withColumn("leading", F.lit(""))
    body = entries.join(first, ["site", "page_id"], "left").selectExpr(
        "site", "part", "page_id", "concat(coalesce(leading, ','), substring(name, 6, length(name) - 6), ':', entry) AS line"
    )
    none = "cast(NULL AS BIGINT) AS page_id"
    head = first.selectExpr("site", "0 AS part", none, """'{"pages":{' AS line""")
    counts = "to_json(struct(critical, major, minor))"
    foot = severity_totals(pages, "site").selectExpr(
        "site", "2 AS part", none, f"""concat('}},"version":', {_json_text(version)}, ',"severity_summary":', {counts}, '}}') AS line"""
    )
    return head.unionByName(body).unionByName(foot)


def _json_text(text: str) -> str:
    return lit(json.dumps(text))


def write_documents(lines: DataFrame, order: list[str], path: str) -> None:
    """Write the lines of many sites' documents (``site``, the columns of ``order``, ``line``) in files shared by neighbouring sites.

    Lines are range-partitioned, so the number of files follows from their bytes: small sites share one, a large site has
    several. Beside them lies an index with the files of a site and its first and last line in each.
    """
    keys = ["site", *order]
    laid = lines.repartitionByRange(*keys).sortWithinPartitions(*keys)
    row = f"monotonically_increasing_id() & {(1 << 33) - 1}"
    numbered = laid.selectExpr("site", "line", f"{row} AS row", "spark_partition_id() AS file")
    numbered.write.partitionBy("file").parquet(f"{path}/lines")
    stored = lines.sparkSession.read.parquet(f"{path}/lines")
    stored.groupBy("site", "file").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row")).write.parquet(f"{path}/index")


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """Where documents lie: ``site, file, first_row, last_row``."""
    return spark.read.parquet(f"{path}/index")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all documents with their number in the document: ``site, n, line``."""
    before = Window.partitionBy("site").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    size = F.sum(F.col("last_row") - F.col("first_row") + 1).over(before)
    starts = document_index(spark, path).withColumn("start", F.coalesce(size, F.lit(0)))
    rows = spark.read.parquet(f"{path}/lines").join(starts, ["site", "file"])
    return rows.selectExpr("site", "start + row - first_row AS n", "line")


def read_document(spark: SparkSession, path: str, site: str) -> DataFrame:
    """The lines of one site's document in order; only its files are read."""
    files = [r["file"] for r in document_index(spark, path).where(F.col("site") == site).select("file").collect()]
    rows = spark.read.parquet(f"{path}/lines").where(F.col("file").isin(files) & (F.col("site") == site))
    return rows.orderBy("file", "row").select("line")


def write_json_report(report: DataFrame, path: str) -> None:
    """Write nested page reports as JSON lines."""
    report.write.option("ignoreNullFields", "false").json(path)

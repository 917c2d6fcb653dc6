"""Severity enrichment and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sightline import vocab
from sightline.functions import severity as S
from sightline.functions.text import lit


def severity_dim(spark: SparkSession) -> DataFrame:
    """The 21 known issue codes with severity and success criterion."""
    return spark.createDataFrame(
        vocab.SEVERITY_ROWS, "code string, severity string, wcag string, wcag_name string, impact string"
    )


def enrich(issues: DataFrame) -> DataFrame:
    """Add severity, criterion, criterion name and impact to any table with a ``code``.

    The dimension has 21 rows whatever is scanned, so it is broadcast. Unknown codes are minor.
    """
    joined = issues.join(F.broadcast(severity_dim(issues.sparkSession)), "code", "left")
    return joined.withColumn("severity", F.expr(f"coalesce(severity, {lit(vocab.MINOR)})")).select(
        *issues.columns, "severity", "wcag", "wcag_name", "impact"
    )


def with_severity(pages: DataFrame) -> DataFrame:
    """The output of ``page_issues`` with enriched issues and the page's own counts.

    Works inside the row: no join, no shuffle, and pages without issues keep their zero counts.
    """
    enriched = pages.withColumn("issues", F.expr(
        "transform(issues, i -> struct(i.analyzer_ord, i.loop_ord, i.node_id, i.check_ord, i.analyzer, i.code, "
        f"i.message, i.context, {S.severity_of('i.code')} AS severity, {S.wcag_of('i.code')} AS wcag, "
        f"{S.wcag_name_of('i.code')} AS wcag_name, {S.impact_of('i.code')} AS impact))"
    ))
    counts = {name: F.expr(f"size(filter(issues, i -> i.severity = {lit(name)}))") for name in ("critical", "major")}
    counted = enriched.withColumns({"total": F.expr("size(issues)"), **counts})
    return counted.withColumn("minor", F.expr("total - critical - major"))


def summarize_by_code(issues: DataFrame, *keys: str) -> DataFrame:
    """Issues per code; a missing code counts as ``UNKNOWN``."""
    code = F.coalesce("code", F.lit("UNKNOWN")).alias("code")
    return issues.groupBy(*keys, code).agg(F.count("*").alias("n"))


def summarize_by_severity(issues: DataFrame, *keys: str) -> DataFrame:
    """Three counts, zeros included; anything that is neither critical nor major is minor."""
    rank = S.severity_rank("severity")
    return issues.groupBy(*keys).agg(
        *[F.expr(f"count_if({rank} = {i})").alias(name) for i, name in enumerate(vocab.SEVERITIES)]
    )


def severity_totals(pages: DataFrame, *keys: str) -> DataFrame:
    """Pages, issues and severity counts per key, from page rows with counts."""
    return pages.groupBy(*keys).agg(
        F.count("*").alias("pages"),
        F.sum("total").alias("issues"),
        *[F.sum(name).alias(name) for name in vocab.SEVERITIES],
    )


def page_and_site_totals(pages: DataFrame) -> DataFrame:
    """Counts per page, per site and overall; the level says which."""
    return pages.groupingSets(
        [[F.col("site"), F.col("url")], [F.col("site")], []], F.col("site"), F.col("url")
    ).agg(
        F.expr("CASE grouping_id() WHEN 0 THEN 'page' WHEN 1 THEN 'site' ELSE 'all' END").alias("level"),
        F.sum("total").alias("issues"),
        *[F.sum(name).alias(name) for name in vocab.SEVERITIES],
    )


def sort_by_severity(issues: DataFrame, *order: str) -> DataFrame:
    """Critical first, then major, then the rest; ``order`` settles ties."""
    return issues.orderBy(F.expr(S.severity_rank("severity")), *order)


def nested_report(pages: DataFrame, version: str = "1") -> DataFrame:
    """One report per page: its issues and both count maps, as nested columns."""
    codes = "array_distinct(transform(issues, i -> coalesce(i.code, 'UNKNOWN')))"
    by_code = (
        f"map_from_entries(transform({codes}, c -> struct(c AS code, "
        "size(filter(issues, i -> coalesce(i.code, 'UNKNOWN') = c)) AS n)))"
    )
    shown = (
        "transform(issues, i -> struct(i.code AS code, i.message AS message, i.context AS context, "
        "i.analyzer AS analyzer, i.severity AS severity, i.wcag AS wcag, i.wcag_name AS wcag_name, "
        "i.impact AS impact))"
    )
    keys = [name for name in ("site", "page_id", "url") if name in pages.columns]
    return pages.selectExpr(
        *keys,
        f"{shown} AS issues",
        f"{by_code} AS summary",
        "struct(critical, major, minor) AS severity_summary",
        f"{lit(version)} AS version",
    )

"""Links found on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sightline.functions.urls import resolve_url, without_fragment


def page_links(doms: DataFrame, *, keep_fragment: bool = False) -> DataFrame:
    """One row per ``a[href]``: its position on the page, the href, and the absolute URL it leads to."""
    found = "transform(filter(dom, e -> e.tag = 'a' AND e.attrs['href'] IS NOT NULL), e -> e.attrs['href'])"
    keys = [name for name in doms.columns if name not in ("dom", "parse_error", "prolog")]
    rows = doms.select(*keys, F.posexplode_outer(F.expr(found)).alias("pos", "href")).where("href IS NOT NULL")
    target = resolve_url("url", "href")
    return rows.withColumn("dst_url", F.expr(target if keep_fragment else without_fragment(target)))

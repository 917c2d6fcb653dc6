"""Crawl rules of sites: robots files and sitemaps, given as tables of their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sightline.functions.color import DECIMAL
from sightline.functions.text import lit, strip
from sightline.functions.urls import path

DIRECTIVES = {"agent": "(?i)^User-agent:", "disallow": "(?i)^Disallow:", "delay": "(?i)^Crawl-delay:"}
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def parse_robots(files: DataFrame) -> DataFrame:
    """Rule groups of robots files (``site, robots_txt``), in file order.

    Every user-agent line starts a group, so of stacked ones only the last gets the rules that
    follow. Groups are numbered within their file: the window spans one file's lines.
    """
    line = strip("line")
    lines = files.select("site", F.posexplode(F.split("robots_txt", r"\R")).alias("pos", "line"))
    kinds = " ".join(f"WHEN line RLIKE {lit(pattern)} THEN {lit(kind)}" for kind, pattern in DIRECTIVES.items())
    directives = lines.selectExpr("site", "pos", f"{line} AS line").selectExpr(
        "site", "pos", f"CASE {kinds} END AS kind", f"{strip("substring(line, instr(line, ':') + 1)")} AS value"
    ).where("kind IS NOT NULL")
    in_file = Window.partitionBy("site").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = directives.withColumn("group_no", F.sum(F.expr("int(kind = 'agent')")).over(in_file).cast("int"))

    def values(kind: str) -> str:
        ordered = f"array_sort(collect_list(struct(pos, value)) FILTER (WHERE kind = {lit(kind)}))"
        return f"transform({ordered}, x -> x.value)"

    # The cast alone would take suffixes such as the d of 5d.
    delay = f"max_by(double(value), pos) FILTER (WHERE kind = 'delay' AND value RLIKE {DECIMAL})"
    return numbered.groupBy("site", "group_no").agg(
        F.expr(f"{values('agent')} AS agents"),
        F.expr(f"{values('disallow')} AS disallow"),
        F.expr(f"{delay} AS crawl_delay"),
    ).where("size(agents) > 0 OR size(disallow) > 0 OR crawl_delay IS NOT NULL")


def choose_group(groups: DataFrame, agent: str) -> DataFrame:
    """The group that applies to ``agent`` (``site, disallow, crawl_delay``); sites without one are absent.

    An exact name beats a name contained in ours, which beats ``*``; the first in the file wins.
    """
    ours = lit(agent.lower())
    tier = (
        f"CASE WHEN exists(agents, a -> a <> '' AND lower(a) = {ours}) THEN 0 "
        f"WHEN exists(agents, a -> a NOT IN ('', '*') AND contains({ours}, lower(a))) THEN 1 "
        "WHEN array_contains(agents, '*') THEN 2 END"
    )
    return groups.withColumn("tier", F.expr(tier)).where("tier IS NOT NULL").groupBy("site").agg(
        F.expr("min_by(struct(disallow, coalesce(crawl_delay, 0D) AS crawl_delay), struct(tier, group_no)) AS chosen")
    ).select("site", "chosen.disallow", "chosen.crawl_delay")


def is_blocked(url: str, disallow: str) -> str:
    """Whether the path of ``url`` starts with any non-empty rule."""
    return f"coalesce(exists({disallow}, d -> d <> '' AND startswith({path(url)}, d)), false)"


def effective_delay(crawl_delay: str, delay: float = 0.0) -> str:
    return f"greatest(coalesce({crawl_delay}, 0D), {delay}D)"


def blocked_urls(urls: DataFrame, chosen: DataFrame) -> DataFrame:
    """Add ``blocked`` to URLs (``site, url``) by the rules of their site, one row per site.

    Left to the optimizer: it broadcasts the rules when they are small, and splits hot sites when not.
    """
    joined = urls.join(chosen.select("site", "disallow"), "site", "left")
    return joined.withColumn("blocked", F.expr(is_blocked("url", "disallow"))).drop("disallow")


def parse_sitemap(files: DataFrame) -> DataFrame:
    """Every location of sitemaps (``site, sitemap_xml``), in order."""
    loc = "loc"
    for entity, character in ENTITIES:
        loc = f"replace({loc}, {lit(entity)}, {lit(character)})"
    found = F.regexp_extract_all("sitemap_xml", F.lit(r"(?is)<loc(?:\s[^>]*)?>(.*?)</loc>"), 1)
    return files.select("site", F.posexplode(found).alias("pos", "loc")).withColumn("loc", F.expr(strip(loc)))

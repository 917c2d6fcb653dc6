"""Following links through a snapshot of fetched pages.

The crawl visits what a first-in-first-out crawler would: the start page, the sitemap, then links in the order their pages were
visited. Any number of requests, also for one site, are crawled side by side, each with its own start, limit and ranks, over one
index of the pages: their links and, for a scan, their issues, both from one parse.

A crawl with a small limit goes by levels, each one set of joins; only the visited addresses of each request pass from level to level,
through files in the shared scratch folder. It has at most as many levels as visits. Without such a limit a site may have as many
levels as pages, so sites whose links fit in a task are searched there, all in one job (``operators/walk.py``); only larger ones, and
what cannot be told apart by numbers, go by levels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window, functions as F, types as T

from sightline import vocab
from sightline.functions.urls import netloc, resolve_url, without_fragment
from sightline.operators.dom import with_dom
from sightline.operators.rules import RuleSet, page_issues
from sightline.operators.summaries import with_severity
from sightline.operators.walk import ALIAS, PAGE, REQUEST, walk
from sightline.session import broadcastable, materialize, scratch_path
from sightline.sources.history import append_scan_results, scan_results
from sightline.sources.pages import with_site
from sightline.sources.robots import is_blocked


# Up to here Spark limits the rows of a group before they are shuffled.
GROUP_LIMIT = 1000
CHUNK_BITS = 16
# Links of one page that a place in the queue has room for.
POS_BITS = 24
# Links of a site, pages and starts counted in, up to which one task searches it; that takes it under 400 MB.
WALK_LINKS = 1 << 23
# The number of an address. Sites on which two addresses share one go by levels.
ADDRESS_ID = "xxhash64({})"


def page_index(
    pages: DataFrame, sites: DataFrame, *, keep_fragment: bool = False, scan: bool = False, rules: RuleSet | None = None
) -> DataFrame:
    """One row per fetched address of the given sites: ``ok``, same-site link ``targets``, and with ``scan`` the enriched ``issues``.

    Links and issues come from one parse. A short list of sites is broadcast and other sites' pages are dropped before parsing;
    with a long one the pages are parsed where they lie and only what was found is joined. Of several fetches of one address the
    latest (highest ``page_id``) counts. Markup does not leave the task that read it.
    """
    chosen = sites.select("site").distinct()
    few = broadcastable(chosen)
    sited = with_site(pages)
    wanted = sited.join(F.broadcast(chosen), "site", "left_semi") if few else sited
    target = resolve_url("url", "h") if keep_fragment else without_fragment(resolve_url("url", "h"))
    hrefs = "transform(filter(dom, e -> e.tag = 'a' AND e.attrs['href'] IS NOT NULL), e -> e.attrs['href'])"
    targets = f"array_distinct(filter(transform({hrefs}, h -> {target}), t -> {netloc('t')} = site))"
    parsed = with_dom(wanted.withColumn("ok", F.expr("coalesce(html <> '', false)")), markup=scan)
    rows = parsed.selectExpr(
        "site", "page_id", f"{without_fragment('url')} AS address", "ok", f"{targets} AS targets", *(["dom"] if scan else [])
    )
    facts = ["ok", "targets"]
    if scan:
        rows = with_severity(page_issues(rows, rules))
        facts += ["page_id", "issues"]
    kept = rows if few else rows.join(chosen, "site", "left_semi")
    return kept.groupBy("address").agg(F.expr(f"max_by(struct({', '.join(facts)}), page_id) AS found")).select(
        "address", *(f"found.{name}" for name in facts)
    )


def link_index(pages: DataFrame, sites: DataFrame, *, keep_fragment: bool = False) -> DataFrame:
    """The index of a crawl that does not scan."""
    return page_index(pages, sites, keep_fragment=keep_fragment)


def crawl(
    pages: DataFrame,
    seeds: DataFrame,
    *,
    max_pages: int | None = vocab.CRAWL_MAX_PAGES,
    robots: DataFrame | None = None,
    sitemap: DataFrame | None = None,
    keep_fragment: bool = False,
    on_level: Callable[[int, int], None] | None = None,
    links: bool = False,
) -> DataFrame:
    """Addresses visited per request (``request, site, url, rank, level, outcome``), at most ``max_pages`` each, all that can be
    reached if it is None.

    ``seeds`` has a start address per request (``request, site, url``; without ``request`` there is one per site, and the result
    has no such column either) and may have a limit of its own for each (``max_pages``, null: none); ``robots`` the chosen rules
    (``site, disallow``); ``sitemap`` locations (``site, pos, loc``). ``pages`` may be a written ``page_index`` as well. The outcome of a
    visit is ``ok``, ``blocked`` or ``failed``; all three count. ``on_level`` is told the level and the number of addresses visited so
    far. ``links`` adds the ``targets`` of visits that are ok.
    """
    keyed = "request" in seeds.columns
    seeds = seeds if keyed else seeds.withColumn("request", F.col("site"))
    index = pages if "targets" in pages.columns else materialize(link_index(pages, seeds, keep_fragment=keep_fragment), "links")
    own = "max_pages" in seeds.columns
    limit = F.col("max_pages").cast("bigint") if own else F.lit(max_pages).cast("bigint")
    limits = seeds.select("request", "site", "url", limit.alias("max_pages"))
    if robots is None:
        limits = limits.withColumn("disallow", F.lit(None).cast("array<string>"))
    else:
        limits = limits.join(robots.select("site", "disallow"), "site", "left")
    # Read at every level, so written once: a row per request.
    seeds = materialize(limits, "seeds")
    top = max_pages
    if own:
        top = seeds.agg(F.expr("CASE WHEN count(*) = count(max_pages) THEN max(max_pages) END")).first()[0]
    visits, waiting, count = [], {}, 0

    def report(level: int, new: int) -> None:
        nonlocal count
        count += new + waiting.pop(level, 0)
        on_level(level, count)

    if top is None or top > GROUP_LIMIT:
        asked, walked = _walked(index, seeds, sitemap)
        visits.append(walked)
        if on_level:
            waiting = {r.level: r.n for r in walked.groupBy("level").agg(F.count("*").alias("n")).collect()}
        seeds = materialize(seeds.join(asked.select("request"), "request", "left_anti"), "seeds")
    if not visits or not seeds.isEmpty():
        visits.append(_by_levels(index, seeds, sitemap, top, report if on_level else None))
    for level in sorted(waiting):
        report(level, 0)
    visited = visits[0] if len(visits) == 1 else visits[0].unionByName(visits[1])
    found = index.select("address", "ok", "targets") if links else index.select("address", "ok")
    shown = ["request"] * keyed + ["site", "url", "rank", "level"]
    outcome = "CASE WHEN blocked THEN 'blocked' WHEN coalesce(ok, false) THEN 'ok' ELSE 'failed' END AS outcome"
    extra = ["CASE WHEN NOT blocked AND ok THEN targets END AS targets"] if links else []
    return visited.join(found, "address", "left").selectExpr(*shown, outcome, *extra)


def _candidates(seeds: DataFrame, sitemap: DataFrame | None) -> DataFrame:
    """What each request starts with (``request, site, url, place``): its own address, then the sitemap."""
    own = seeds.selectExpr("request", "site", "url", "cast(0 AS BIGINT) AS place")
    if sitemap is None:
        return own
    return own.unionByName(_listed(seeds, sitemap).selectExpr("request", "site", "loc AS url", "cast(pos + 1 AS BIGINT) AS place"))


def _by_levels(index, seeds, sitemap, top, on_level) -> DataFrame:
    """The visits of all requests, level by level."""
    spark = index.sparkSession
    store = scratch_path(spark, "crawl")
    limits = seeds.select("request", "max_pages", "disallow")
    candidates = _candidates(seeds, sitemap)
    state = limits.withColumn("seen", F.lit(0).cast("bigint"))
    visited, level = None, 0
    while True:
        accepted = _accept(candidates, visited, state, top)
        accepted.write.mode("overwrite").parquet(f"{store}/level={level}")
        fresh = spark.read.schema(accepted.schema).parquet(f"{store}/level={level}")
        visited = spark.read.schema(T.StructType([*accepted.schema.fields, T.StructField("level", T.IntegerType())])).parquet(store)
        new = fresh.count()
        if not new:
            return visited
        if on_level:
            on_level(level, new)
        # The file of the last level is small beside the index, which stays where it is if that can be broadcast.
        leading = fresh.where("NOT blocked").select("request", "site", "rank", "address")
        known = index.where("ok AND size(targets) > 0").select("address", "targets")
        candidates = known.join(leading, "address").select(
            "request", "site", "rank", F.posexplode("targets").alias("pos", "url")
        ).selectExpr("request", "site", "url", f"shiftleft(rank, {POS_BITS}) + pos AS place")
        # Ranks have no gaps, so the last one is the number of visits so far; requests without new visits are over.
        state = fresh.groupBy("request").agg(F.max("rank").alias("seen")).join(limits, "request")
        level += 1


def _walked(index: DataFrame, seeds: DataFrame, sitemap: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The requests that are searched in one task each or together with others of their site, and their visits.

    A request is if it starts on its own site, its rows in ``seeds`` are all alike, and its site has at most ``WALK_LINKS`` links, no
    two addresses of one number among them. Links lead to the same site, so that is all a search needs. Many requests to one site are
    dealt to more tasks, each with the site's links, so that none has much more than that to follow.
    """
    alike = seeds.where("request IS NOT NULL").groupBy("request").agg(
        F.count("*").alias("copies"),
        F.expr("count(DISTINCT struct(site, url, max_pages, disallow)) AS kinds"),
        F.expr("any_value(struct(site, url, max_pages, disallow)) AS own"),
    ).where("kinds = 1").select("request", "copies", "own.*").where(f"{netloc('url')} = site")
    known = index.where("ok AND size(targets) > 0").select(F.expr(f"{netloc('address')} AS site"), "address", "targets")
    sizes = known.selectExpr("site", "cast(size(targets) + 1 AS BIGINT) AS n")
    if sitemap is not None:
        sizes = sizes.unionByName(sitemap.where(f"{netloc('loc')} = site").selectExpr("site", "1L AS n"))
    # The rules of a request are those of its site.
    per_site = alike.groupBy("site").agg(F.count("*").alias("requests"), F.expr("any_value(disallow) AS disallow"))
    weighed = per_site.join(sizes.groupBy("site").agg(F.sum("n").alias("n")), "site", "left").withColumn("n", F.expr("coalesce(n, 0) + 1"))
    small = weighed.where(f"n <= {WALK_LINKS}")
    sites = materialize(small.selectExpr("site", "disallow", f"cast(ceil(requests * n / {WALK_LINKS}) AS INT) AS buckets"), "sites")

    fetched = known.join(sites, "site")
    begun = alike.select("site", "url")
    if sitemap is not None:
        begun = begun.union(sitemap.where(f"{netloc('loc')} = site").select("site", "loc"))
    begun = begun.join(sites.select("site"), "site", "left_semi")
    urls = fetched.select("site", F.explode("targets").alias("url")).union(fetched.select("site", "address")).union(begun)
    nodes = materialize(urls.distinct().withColumn("id", F.expr(ADDRESS_ID.format("url"))), "addresses")
    unclear = nodes.groupBy("site", "id").agg(F.count("*").alias("n")).where("n > 1").select("site").distinct()
    asked = materialize(
        alike.drop("disallow").join(sites, "site").join(unclear, "site", "left_anti").withColumn("bucket", F.expr("cast(pmod(xxhash64(request), buckets) AS INT)")),
        "asked",
    )

    buckets = "explode(sequence(0, buckets - 1)) AS bucket"
    blank = "cast(NULL AS BIGINT) AS max_pages, cast(NULL AS BIGINT) AS copies"
    request = f"cast(NULL AS {dict(asked.dtypes)['request']}) AS request"
    # Blocked pages are not followed. Rules look at the path alone, so an address and its page are blocked alike.
    pages = fetched.where(f"NOT {is_blocked('address', 'disallow')}").selectExpr(
        "site", buckets, f"{PAGE} AS kind", f"{ADDRESS_ID.format('address')} AS id", f"transform(targets, t -> {ADDRESS_ID.format('t')}) AS ids",
        request, *blank.split(", "),
    )
    aliases = nodes.where("contains(url, '#')").join(sites, "site").selectExpr(
        "site", buckets, f"{ALIAS} AS kind", "id", f"array({ADDRESS_ID.format(without_fragment('url'))}) AS ids", request, *blank.split(", "),
    )
    first = _candidates(asked, sitemap).groupBy("request", "url").agg(F.min("place").alias("place"))
    starts = first.groupBy("request").agg(F.expr(
        f"transform(array_sort(collect_list(struct(place, {ADDRESS_ID.format('url')} AS id))), x -> x.id) AS ids"
    ))
    requests = asked.join(starts, "request").selectExpr(
        "site", "bucket", f"{REQUEST} AS kind", "cast(NULL AS BIGINT) AS id", "ids", "request", "max_pages", "copies",
    )
    rows = pages.unionByName(aliases).unionByName(requests).repartition("site", "bucket").sortWithinPartitions("site", "bucket", "kind")
    schema = T.StructType([
        T.StructField("site", T.StringType()), asked.schema["request"], T.StructField("max_pages", T.LongType()),
        T.StructField("copies", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("first", T.LongType()),
        T.StructField("ids", T.ArrayType(T.LongType())),
    ])
    runs = materialize(rows.mapInArrow(walk, schema), "runs")
    # A request that is there several times visits everything as often.
    places = runs.select("*", F.posexplode("ids").alias("pos", "id")).selectExpr(
        "*", "explode(sequence(1L, copies)) AS copy"
    ).withColumn("rank", F.expr("(first + pos) * copies + copy")).where("max_pages IS NULL OR rank <= max_pages")
    visits = places.join(nodes, ["site", "id"]).join(sites.select("site", "disallow"), "site").selectExpr(
        "request", "site", "url", "rank", f"coalesce({is_blocked('url', 'disallow')}, false) AS blocked", f"{without_fragment('url')} AS address", "level",
    )
    return asked, materialize(visits, "visits")


def _listed(seeds: DataFrame, sitemap: DataFrame) -> DataFrame:
    """The sitemap locations that each request starts with besides its own address."""
    return sitemap.where(f"{netloc('loc')} = site").join(seeds.select("request", "site"), "site")


def _numbered(rows: DataFrame) -> DataFrame:
    """Numbers the rows of each request in visiting order, however many they are, in chunks of neighbouring rows."""
    order = ["request", "place"]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = materialize(laid.withColumn("chunk", F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS)), "frontier")
    sizes = held.groupBy("request", "chunk").agg(F.count("*").alias("size"))
    before = Window.partitionBy("request").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("request", "chunk", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("request", "chunk").orderBy("place")
    numbered = held.withColumn("in_chunk", F.row_number().over(inside)).join(base, ["request", "chunk"])
    return numbered.withColumn("row", F.col("base") + F.col("in_chunk")).drop("chunk", "base", "in_chunk")


def _accept(candidates, visited, state, top) -> DataFrame:
    """The candidates that are visited next, with their rank, whether rules block them, and where to look them up.

    ``state`` has a row per request: the visits so far (``seen``), its limit and its rules.
    """
    first = candidates.groupBy("request", "site", "url").agg(F.min("place").alias("place"))
    if visited is not None:
        first = first.join(visited.select("request", "url"), ["request", "url"], "left_anti")
    unseen = first.join(state, "request")
    if top is not None and top <= GROUP_LIMIT:
        # The limit on the row number lets every task drop what cannot be visited before the shuffle.
        in_request = Window.partitionBy("request").orderBy("place")
        ranked = unseen.withColumn("row", F.row_number().over(in_request)).where(f"row <= {int(top)}")
    else:
        ranked = _numbered(unseen)
    taken = ranked.withColumn("rank", F.expr("cast(seen + row AS BIGINT)")).where("max_pages IS NULL OR rank <= max_pages")
    return taken.selectExpr(
        "request", "site", "url", "rank", f"coalesce({is_blocked('url', 'disallow')}, false) AS blocked", f"{without_fragment('url')} AS address",
    )


def crawl_basic(pages: DataFrame, seeds: DataFrame, *, max_pages: int = vocab.BASIC_CRAWL_MAX_PAGES) -> DataFrame:
    """The simple crawl: no rules, no sitemap, fragments kept, failed visits left out."""
    return crawl(pages, seeds, max_pages=max_pages, keep_fragment=True).where("outcome = 'ok'")


def crawl_progress(visits: DataFrame) -> DataFrame:
    """Per site and level: addresses visited at it and up to it."""
    per_level = visits.groupBy("site", "level").agg(F.count("*").alias("visited"))
    so_far = Window.partitionBy("site").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    return per_level.withColumn("scanned", F.sum("visited").over(so_far))


def page_progress(visits: DataFrame, seeds: DataFrame, sitemap: DataFrame | None = None) -> DataFrame:
    """What a crawler reports after each page it fetched: pages visited so far, addresses found so far, and the page.

    Takes a crawl with ``links``, its seeds and its sitemap. An address is found by the first visit that links to it, unless the
    crawl started with it; numbers of first discoveries are added up over ranks in chunks, so a crawl of any length is many tasks.
    A page's own links count from the next one on.
    """
    key = "request" if "request" in visits.columns else "site"
    seeds = seeds if "request" in seeds.columns else seeds.withColumn("request", F.col("site"))
    visits = visits if key == "request" else visits.withColumn("request", F.col("site"))
    fetched = visits.where("outcome = 'ok'")
    start = seeds.select("request", "url")
    begun = seeds.select("request", F.lit(1).cast("bigint").alias("n"))
    if sitemap is not None:
        listed = _listed(seeds, sitemap)
        start = start.union(listed.select("request", "loc"))
        begun = begun.unionByName(listed.groupBy("request").agg(F.count("*").alias("n")))
    begun = begun.groupBy("request").agg(F.sum("n").alias("begun"))
    finds = fetched.select("request", "rank", F.explode("targets").alias("url")).groupBy("request", "url").agg(F.min("rank").alias("rank"))
    fresh = finds.join(start, ["request", "url"], "left_anti").groupBy("request", "rank").agg(F.count("*").alias("fresh"))
    counted = fetched.select("request", "site", "url", "rank").join(fresh, ["request", "rank"], "left").selectExpr(
        "*", "coalesce(fresh, 0) AS n", f"shiftright(rank, {CHUNK_BITS}) AS chunk"
    )
    sums = counted.groupBy("request", "chunk").agg(F.sum("n").alias("n"))
    chunks_before = Window.partitionBy("request").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("request", "chunk", F.coalesce(F.sum("n").over(chunks_before), F.lit(0)).alias("base"))
    rows_before = Window.partitionBy("request", "chunk").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    local = counted.withColumn("so_far", F.coalesce(F.sum("n").over(rows_before), F.lit(0)))
    joined = local.join(base, ["request", "chunk"]).join(begun, "request")
    shown = ["request", "site"] if key == "request" else ["site"]
    return joined.selectExpr(*shown, "url", "rank", "rank AS scanned", "begun + base + so_far AS found")


COUNTS = ("total", "critical", "major", "minor")


def scan_visits(pages: DataFrame, visits: DataFrame, rules: RuleSet | None = None, exclude: Iterable[str] = ()) -> DataFrame:
    """The visits with what a scan finds: ``page_id``, ``issues`` and their counts; blocked and failed addresses have none.

    ``pages`` may be an index made for a scan, which is then only looked up. Rules in ``exclude`` are left out, and for each visit those
    in its own column ``exclude`` (names), where there is one.
    """
    index = pages if "issues" in pages.columns else page_index(pages, visits, scan=True, rules=rules)
    wanted = visits.withColumn("address", F.expr(f"CASE WHEN outcome = 'ok' THEN {without_fragment('url')} END"))
    joined = wanted.join(index.select("address", "page_id", "issues"), "address", "left").drop("address")
    skipped = F.array(*map(F.lit, exclude)).cast("array<string>")
    if "exclude" in visits.columns:
        skipped = F.concat(skipped, F.coalesce("exclude", F.array().cast("array<string>")))
    kept = joined.withColumn("skipped", skipped).withColumn(
        "issues", F.expr("CASE WHEN size(skipped) = 0 THEN issues ELSE filter(issues, i -> NOT array_contains(skipped, i.analyzer)) END")
    )
    counts = {name: f"size(filter(issues, i -> i.severity = '{name}'))" for name in vocab.SEVERITIES}
    sizes = {"total": "size(issues)", **counts}
    return kept.drop("skipped").withColumns({name: F.expr(f"greatest(coalesce({sizes[name]}, 0), 0)") for name in COUNTS})


def scan_sites(
    pages: DataFrame, seeds: DataFrame, *, rules: RuleSet | None = None, exclude: Iterable[str] = (), **crawl_options
) -> DataFrame:
    """Crawl and scan in one parse of the pages: the visits of ``crawl`` with issues and counts.

    ``seeds`` may name rules to leave out per request (``exclude``). Links and issues are written once, by address; the crawl
    reads the links of it, the result looks up the issues of what was visited.
    """
    index = materialize(
        page_index(pages, seeds, keep_fragment=crawl_options.get("keep_fragment", False), scan=True, rules=rules), "page-index",
    )
    visits = crawl(index, seeds, **crawl_options)
    if "exclude" in seeds.columns:
        key = "request" if "request" in seeds.columns else "site"
        visits = visits.join(seeds.select(key, "exclude"), key)
    return scan_visits(index, visits, exclude=exclude)


def scan_to_history(pages: DataFrame, seeds: DataFrame, path: str, ts: int | None = None, batch: str | None = None, **options) -> DataFrame:
    """Crawl, scan and append to the history in one go. Only pages that were fetched are stored, an address once per site however
    many requests visited it; returns all visits as written to the scratch folder."""
    scanned = materialize(scan_sites(pages, seeds, **options), "site-scan")
    fetched = scanned.where("outcome = 'ok'")
    if "request" in scanned.columns:
        # Requests may leave out different rules; the least request of an address speaks for it.
        fetched = fetched.groupBy("site", "url").agg(F.min_by("issues", "request").alias("issues"))
    append_scan_results(scan_results(fetched, ts), path, batch)
    return scanned

"""The registered queries: each takes a session and a folder of tables and returns a result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sightline.functions import color as C, severity as S, urls as U
from sightline.functions.text import lit, words
from sightline.operators import fixes as X, limiter as L, rules as R, summaries as A
from sightline.operators.dom import elements, with_dom
from sightline.operators.links import page_links
from sightline.operators.nodes import HEADINGS, descendants
from sightline.plans import corpora, crawl as G, report as P, requests as V, run_store
from sightline.plans.scan import scan_issues, scan_pages, site_severity_summary
from sightline.session import materialize, scratch_path
from sightline.sources import history, robots, runs
from sightline.sources.pages import fetch_outcomes, read_pages
from sightline.streaming import limiter_stream as LS, scan_stream as SS
from sightline.vocab import RETRY_ATTEMPTS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_pages(spark, f"{sf}/pages.parquet")


def _injected(spark: SparkSession, sf: str) -> DataFrame:
    return corpora.injected(_pages(spark, sf))


def _kept_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A scan written out once, for results that are sorted or read several times."""
    return materialize(scan_pages(_injected(spark, sf)), "scan")


# -- plain pages ------------------------------------------------------------------------------


@query
def page_elements_by_tag(spark, sf):
    found = elements(with_dom(_pages(spark, sf), markup=False))
    return found.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query
def page_titles(spark, sf):
    found = elements(with_dom(_pages(spark, sf), markup=False))
    return found.where("tag = 'title'").select("page_id", F.col("text").alias("title"))


@query
def page_headings(spark, sf):
    """Heading levels of every page in document order."""
    levels = f"filter(dom, e -> e.tag IN ({words(HEADINGS)}))"
    return with_dom(_pages(spark, sf), markup=False).selectExpr(
        "page_id", f"array_join(transform({levels}, e -> substring(e.tag, 2, 1)), ' ') AS levels"
    )


@query
def elements_by_class(spark, sf):
    found = elements(with_dom(_pages(spark, sf), markup=False))
    return found.where("map_contains_key(attrs, 'class')").groupBy(
        "page_id", "tag", F.expr("attrs['class']").alias("class")
    ).agg(F.count("*").alias("n"))


QUERIES["page_links"] = lambda spark, sf: page_links(with_dom(_pages(spark, sf), markup=False)).select(
    "page_id", "pos", "href", "dst_url"
)
QUERIES["site_severity_summary"] = lambda spark, sf: site_severity_summary(_pages(spark, sf))


# -- injected pages: issues ---------------------------------------------------------------------


@query
def injected_issues(spark, sf):
    """Every issue of every page, with its place in the page's report."""
    found = R.page_issues(with_dom(_injected(spark, sf)))
    placed = found.select("page_id", "url", "k", F.posexplode_outer("issues").alias("pos", "issue"))
    return placed.where("issue IS NOT NULL").select(
        "page_id", "url", "k", "pos", "issue.analyzer", "issue.code", "issue.message", "issue.context"
    )


def _rule_query(rule: R.Rule, code: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        only = R.Rule(rule.name, rule.description, tuple(c for c in rule.checks if c.code == code))
        found = scan_issues(_injected(spark, sf), rules=R.RuleSet([only]))
        return found.select("page_id", "url", "code", "message", "context")

    return run


for _rule in R.default_rules().active():
    for _code in dict.fromkeys(check.code for check in _rule.checks):
        QUERIES[f"rule_{_code.lower()}"] = _rule_query(_rule, _code)


@query
def issues_excluding(spark, sf):
    skipped = R.rule_names("document_structure, contrast,, aria")
    return scan_issues(_injected(spark, sf), exclude=skipped).select(
        "page_id", "analyzer", "code", "message", "context"
    )


@query
def legacy_rules(spark, sf):
    return scan_issues(_injected(spark, sf), rules=R.legacy_rules()).select("page_id", "code", "message", "context")


@query
def table_contents(spark, sf):
    """Rows, headers and cells of every table, from the containment relation."""
    parsed = with_dom(_injected(spark, sf), markup=False).select("page_id", "dom")
    return descendants(parsed, "e.tag IN ('tr', 'th', 'td')").groupBy("page_id", "container_id").agg(
        F.expr("count_if(tag = 'tr')").alias("n_rows"),
        F.expr("count_if(tag = 'th')").alias("n_headers"),
        F.expr("count_if(tag = 'td')").alias("n_cells"),
    ).drop("container_id")


def _has_table(html: str) -> list[dict]:
    if "<footer>" not in html:
        raise ValueError("no footer")
    return [{"code": "HAS_TABLE", "message": "Page has a table."}] if "<table" in html else []


@query
def custom_html_rule(spark, sf):
    found = R.html_rule(_injected(spark, sf), "no_tables", _has_table, keys=("page_id", "k"))
    return found.select("page_id", "analyzer", "code", "message", F.expr("concat('k=', k)").alias("context"))


@query
def analyzers(spark, sf):
    """Every rule with its description and the number of issues it reports on the injected pages."""
    return _rule_counts(spark, _injected(spark, sf))


@query
def idle_analyzers(spark, sf):
    """The same over the plain pages, where most rules find nothing."""
    return _rule_counts(spark, _pages(spark, sf))


def _rule_counts(spark: SparkSession, pages: DataFrame) -> DataFrame:
    counts = scan_issues(pages).groupBy("analyzer").agg(F.count("*").alias("issues"))
    names = R.default_rules().table(spark)
    joined = names.join(F.broadcast(counts), names["name"] == counts["analyzer"], "left")
    return joined.select("name", "description", F.coalesce("issues", F.lit(0)).alias("issues"))


# -- injected pages: counts -----------------------------------------------------------------------


@query
def enriched_issues(spark, sf):
    found = scan_issues(_injected(spark, sf)).select("page_id", "url", "code", "message", "context")
    return A.enrich(found)


@query
def issues_sorted(spark, sf):
    """Issues in severity order, with their place on the page."""
    scanned = _kept_scan(spark, sf)
    ranked = (
        f"array_sort(transform(issues, i -> struct({S.severity_rank('i.severity')} AS severity_rank, i.analyzer_ord, "
        "i.loop_ord, i.node_id, i.check_ord, i.code, i.severity)))"
    )
    placed = scanned.select("page_id", F.posexplode_outer(F.expr(ranked)).alias("place", "issue"))
    return placed.where("issue IS NOT NULL").select(
        "page_id", "issue.code", "issue.severity", "issue.severity_rank", "place"
    ).orderBy("severity_rank", "page_id", "place")


@query
def issues_by_code(spark, sf):
    return A.summarize_by_code(scan_issues(_injected(spark, sf)))


def _site_issues(spark: SparkSession, sf: str) -> DataFrame:
    return R.issue_rows(scan_pages(_injected(spark, sf)).select("site", "url", "issues"))


@query
def issues_by_severity(spark, sf):
    return A.summarize_by_severity(_site_issues(spark, sf), "site")


@query
def severity_styles(spark, sf):
    return _site_issues(spark, sf).groupBy("severity").agg(F.count("*").alias("n")).selectExpr(
        "severity", f"{S.severity_color('severity')} AS color", f"{S.severity_emoji('severity')} AS emoji", "n"
    )


@query
def page_site_totals(spark, sf):
    return A.page_and_site_totals(scan_pages(_injected(spark, sf), markup=False))


@query
def issue_count_per_page(spark, sf):
    return scan_pages(_injected(spark, sf), markup=False).select(
        "page_id", "url", "total", "critical", "major", "minor"
    )


@query
def injected_site_summary(spark, sf):
    return site_severity_summary(_injected(spark, sf))


# -- injected pages: reports ----------------------------------------------------------------------

GENERATED = "2024-01-01 00:00:00"


@query
def page_overview(spark, sf):
    return P.page_overview(_kept_scan(spark, sf))


@query
def issue_details(spark, sf):
    return P.issue_details(scan_pages(_injected(spark, sf)))


@query
def site_header(spark, sf):
    return P.site_header(scan_pages(_injected(spark, sf), markup=False), GENERATED, "Sites & pages")


@query
def page_header(spark, sf):
    return P.page_header(scan_pages(_injected(spark, sf), markup=False), GENERATED)


@query
def console_pages(spark, sf):
    return P.console_pages(_kept_scan(spark, sf))


@query
def top_issues(spark, sf):
    return P.top_issues(scan_pages(_injected(spark, sf)))


@query
def issues_beyond(spark, sf):
    return P.issues_beyond(scan_pages(_injected(spark, sf), markup=False))


@query
def nested_report(spark, sf):
    report = A.nested_report(scan_pages(_injected(spark, sf)))
    text = "to_json(struct(issues, severity_summary, version), map('ignoreNullFields', 'false'))"
    codes = "array_join(transform(array_sort(map_entries(summary)), c -> concat(c.key, '=', c.value)), ',')"
    return report.selectExpr("page_id", "url", f"{text} AS report", f"{codes} AS summary")


@query
def report_lines(spark, sf):
    """Line counts of the HTML report of every site, by part."""
    lines = P.report_lines(_kept_scan(spark, sf), GENERATED)
    return lines.groupBy("site", "part").agg(F.count("*").alias("n_lines"))


@query
def site_documents(spark, sf):
    """The nested report of every site, line by line, as written to shared files and read back."""
    path = scratch_path(spark, "documents")
    P.write_documents(P.site_document(_kept_scan(spark, sf)), ["part", "page_id"], path)
    return P.read_documents(spark, path)


@query
def report_text(spark, sf):
    """The HTML report of every site, line by line, as written to shared files and read back."""
    path = scratch_path(spark, "documents")
    lines = P.report_lines(_kept_scan(spark, sf), GENERATED)
    P.write_documents(lines, ["part", "weight", "page_id", "place"], path)
    return P.read_documents(spark, path)


# -- colours --------------------------------------------------------------------------------------


def _line_colors(spark: SparkSession, sf: str) -> DataFrame:
    return corpora.line_colors(spark.read.parquet(f"{sf}/lineitem.parquet"))


@query
def parsed_colors(spark, sf):
    return _line_colors(spark, sf).selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "value", f"{C.parse_color('value')} AS color"
    )


@query
def parsed_fix_colors(spark, sf):
    return _line_colors(spark, sf).selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "value", f"{C.parse_fix_color('value')} AS color"
    )


@query
def contrast_ratios(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "fg", "bg"]
    bright = _line_colors(spark, sf).selectExpr(
        *keys, f"{C.relative_luminance('fg')} AS fg_light", f"{C.relative_luminance('bg')} AS bg_light"
    )
    return bright.selectExpr(
        *keys, f"round({C.luminance_ratio('fg_light', 'bg_light')}, 6) AS ratio", "round(fg_light, 6) AS luminance",
        f"{C.foreground_on('bg_light')} AS recommended",
    )


# -- links, robots, crawls ------------------------------------------------------------------------


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _graph(spark: SparkSession, sf: str) -> DataFrame:
    return corpora.site_graph(_pages(spark, sf))


@query
def resolved_links(spark, sf):
    """Every link of the linked snapshot, resolved, and whether it stays on its site."""
    links = page_links(with_dom(_graph(spark, sf), markup=False))
    return links.selectExpr(
        "page_id", "pos", "href", "dst_url", f"{U.netloc('dst_url')} = {U.netloc('url')} AS same_site"
    )


AGENT = "sightline-scanner"


@query
def robots_rules(spark, sf):
    found = robots.parse_robots(corpora.customer_robots(_table(spark, sf, "customer")))
    return found.selectExpr(
        "site", "group_no", "array_join(agents, '|') AS agents", "array_join(disallow, '|') AS disallow", "crawl_delay"
    )


@query
def robots_choice(spark, sf):
    groups = robots.parse_robots(corpora.customer_robots(_table(spark, sf, "customer")))
    return robots.choose_group(groups, AGENT).selectExpr(
        "site", "array_join(disallow, '|') AS disallow", "crawl_delay"
    )


@query
def crawl_delay(spark, sf):
    """The pause between requests per site, never under one second; sites without rules included."""
    files = corpora.customer_robots(_table(spark, sf, "customer"))
    chosen = robots.choose_group(robots.parse_robots(files), AGENT)
    return files.select("site").join(chosen, "site", "left").selectExpr(
        "site", f"{robots.effective_delay('crawl_delay', 1.0)} AS delay"
    )


@query
def blocked_urls(spark, sf):
    groups = robots.parse_robots(corpora.customer_robots(_table(spark, sf, "customer")))
    urls = corpora.order_urls(_table(spark, sf, "orders"))
    return robots.blocked_urls(urls, robots.choose_group(groups, AGENT)).select("o_orderkey", "url", "blocked")


@query
def valid_urls(spark, sf):
    """Seed addresses sorted into valid and rejected."""
    text = "get(array('http://c', 'HTTPS://c', 'ftp://c', 'c', 'http:///'), cast(o_orderkey % 5 AS INT))"
    seeds = _table(spark, sf, "orders").selectExpr("o_orderkey", f"concat({text}, o_custkey, '.test/x') AS url")
    return seeds.selectExpr("o_orderkey", "url", f"{U.valid_scan_url('url')} AS valid")


@query
def sitemap_urls(spark, sf):
    return robots.parse_sitemap(corpora.customer_sitemaps(_table(spark, sf, "customer"))).select("site", "pos", "loc")


def _crawl(spark: SparkSession, sf: str, max_pages: int | None = 40) -> tuple[DataFrame, DataFrame]:
    graph = _graph(spark, sf)
    rules = robots.choose_group(robots.parse_robots(corpora.robots_files(graph)), AGENT)
    listed = robots.parse_sitemap(corpora.sitemap_files(graph))
    visits = G.crawl(graph, corpora.graph_seeds(graph), max_pages=max_pages, robots=rules, sitemap=listed)
    return graph, visits


@query
def crawl_site(spark, sf):
    return _crawl(spark, sf)[1]


@query
def crawl_all(spark, sf):
    """The same crawl to its end."""
    return _crawl(spark, sf, None)[1]


@query
def crawl_basic(spark, sf):
    graph = _graph(spark, sf)
    return G.crawl_basic(graph, corpora.graph_seeds(graph)).select("site", "url", "rank", "outcome")


@query
def crawl_progress(spark, sf):
    return G.crawl_progress(_crawl(spark, sf)[1])


def _crawl_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, dict]:
    graph = _graph(spark, sf)
    rules = robots.choose_group(robots.parse_robots(corpora.robots_files(graph)), AGENT)
    return graph, {"robots": rules, "sitemap": robots.parse_sitemap(corpora.sitemap_files(graph))}


@query
def crawl_page_progress(spark, sf):
    """Pages visited and addresses found after each page that was fetched."""
    graph, inputs = _crawl_inputs(spark, sf)
    seeds = corpora.graph_seeds(graph)
    visits = G.crawl(graph, seeds, max_pages=40, links=True, **inputs)
    return G.page_progress(visits, seeds, inputs["sitemap"])


@query
def scan_site(spark, sf):
    """A crawl and its scan: issues of every visited address, in visiting order."""
    graph, inputs = _crawl_inputs(spark, sf)
    scanned = G.scan_sites(graph, corpora.graph_seeds(graph), max_pages=40, **inputs)
    return scanned.select("site", "url", "rank", "outcome", "total", "critical", "major", "minor")


@query
def scan_site_requests(spark, sf):
    """Two requests per site with starts, limits and left-out rules of their own, over one parse."""
    graph, inputs = _crawl_inputs(spark, sf)
    scanned = G.scan_sites(graph, corpora.graph_requests(graph), **inputs)
    return scanned.select("request", "site", "url", "rank", "level", "outcome", "total")


@query
def site_scan_history(spark, sf):
    """The history that the same requests leave: every fetched address once, with its issues."""
    graph, inputs = _crawl_inputs(spark, sf)
    path = scratch_path(spark, "site-history")
    history.init_scan_store(spark, path)
    G.scan_to_history(graph, corpora.graph_requests(graph), path, 1_700_000_000, **inputs)
    return _codes(history.read_scan_history(spark, path))


# -- history and runs -------------------------------------------------------------------------------


def _history(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "scans")
    history.init_scan_store(spark, path)
    scanned = _kept_scan(spark, sf)
    for ts in (1_700_000_000, 1_700_100_000):
        rows = history.scan_results(scanned, ts).withColumn("ts", F.expr("ts + length(url)"))
        history.append_scan_results(rows, path)
    return path


def _codes(rows: DataFrame) -> DataFrame:
    return rows.selectExpr("site", "url", "array_join(transform(issues, i -> i.code), ',') AS codes", "ts")


@query
def scan_history(spark, sf):
    return _codes(history.read_scan_history(spark, _history(spark, sf)))


@query
def site_history(spark, sf):
    """History of the site of the first page."""
    site = _pages(spark, sf).orderBy("page_id").selectExpr(f"{U.netloc('url')} AS site").first()["site"]
    return _codes(history.read_scan_history(spark, _history(spark, sf), site))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return corpora.order_runs(_table(spark, sf, "orders"))


@query
def scan_runs(spark, sf):
    return runs.current_runs(_runs(spark, sf))


@query
def recent_runs(spark, sf):
    return runs.recent_runs(_runs(spark, sf), 10)


@query
def run_after_delete(spark, sf):
    """The runs once the first has been deleted too."""
    events = _runs(spark, sf)
    first = runs.current_runs(events).agg(F.min("scan_id").alias("scan_id")).first()["scan_id"]
    gone = runs.deletion(events, first)
    return runs.current_runs(events.unionByName(gone)).groupBy("status").agg(F.count("*").alias("n"))


# -- fixes ------------------------------------------------------------------------------------------

ALT_TEXTS = {"i.png": "Icon"}


@query
def applied_fixes(spark, sf):
    return X.fix_rows(X.apply_fixes(_injected(spark, sf), ALT_TEXTS)).select("page_id", "pos", "code", "fix", "context")


@query
def fix_summary(spark, sf):
    return X.fix_summary(X.apply_fixes(_injected(spark, sf), ALT_TEXTS))


@query
def fix_report(spark, sf):
    report = X.fix_report(X.apply_fixes(_injected(spark, sf), ALT_TEXTS))
    return report.selectExpr("page_id", "n", "array_join(lines, '\n') AS lines", "fix_error")


@query
def alt_fixes_from_parts(spark, sf):
    """Alternative texts looked up in a table."""
    texts = corpora.part_names(_table(spark, sf, "part"))
    fixed = X.apply_fixes(corpora.planted_images(_pages(spark, sf)), texts)
    return X.fix_rows(fixed).select("page_id", "code", "fix", "context")


@query
def fixed_pages(spark, sf):
    """The rewritten pages themselves."""
    return X.apply_fixes(_injected(spark, sf), ALT_TEXTS).select("page_id", "url", "fixed_html")


@query
def fix_edits(spark, sf):
    """The rewriting as a script of edits."""
    return X.edit_rows(X.apply_fixes(_injected(spark, sf), ALT_TEXTS, edits=True)).select("page_id", "pos", "at", "old", "new")


@query
def undone_pages(spark, sf):
    """The rewritten pages with their edits taken back."""
    fixed = X.apply_fixes(_injected(spark, sf), ALT_TEXTS, edits=True)
    return fixed.select("page_id", "url", X.spliced("fixed_html", "edits", undo=True).alias("html"))


@query
def refixed_pages(spark, sf):
    """Fixes still needed after fixing, and the issues of the fixed pages."""
    fixed = X.apply_fixes(_injected(spark, sf), ALT_TEXTS)
    again = scan_issues(fixed.selectExpr("page_id", "url", "fixed_html AS html"))
    return again.groupBy("code").agg(F.count("*").alias("n"))


@query
def suggestion_prompts(spark, sf):
    pages = _injected(spark, sf)
    scanned = R.page_issues(with_dom(pages.withColumn("source", F.col("html")))).withColumnRenamed("source", "html")
    return X.suggestion_prompts(scanned)


@query
def site_prompts(spark, sf):
    """Request texts about whole sites; pages are put on three sites, each with more of them than a text has room for."""
    sited = _pages(spark, sf).selectExpr(
        "page_id", "concat('s', page_id % 3, '.test') AS site", "concat('http://s', page_id % 3, '.test/', url) AS url"
    )
    return X.site_prompts(sited)


# -- request logs -------------------------------------------------------------------------------------


TICK_MICROS = 97_656_250  # a month of events in under half a minute


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return L.request_log(_table(spark, sf, "events"), TICK_MICROS)


@query
def rate_grants(spark, sf):
    return L.rate_grants(_log(spark, sf).select("host", "id", "t"), 2.0).selectExpr(
        "host", "id", "round(granted, 6) AS granted", "round(waited, 6) AS waited"
    )


@query
def adaptive_rates(spark, sf):
    return L.adaptive_rates(_log(spark, sf)).selectExpr(
        "host", "round(current_rate, 6) AS current_rate", "success_count", "error_count", "slow_response_count"
    )


@query
def busy_adaptive_rates(spark, sf):
    """The same log folded onto three hosts, so that each is cut into many chunks."""
    log = _log(spark, sf).withColumn("host", F.col("host") % 3)
    return L.adaptive_rates(log, bits=7).selectExpr(
        "host", "round(current_rate, 6) AS current_rate", "success_count", "error_count", "slow_response_count"
    )


@query
def request_stats(spark, sf):
    return L.request_stats(_log(spark, sf))


@query
def fetch_results(spark, sf):
    return fetch_outcomes(corpora.fetch_log(_table(spark, sf, "events")), RETRY_ATTEMPTS).select(
        "event_id", "url", "attempt", "status", "error", "outcome"
    )


# -- streams --------------------------------------------------------------------------------------------


def _drained(query) -> None:
    """Wait until a stream has taken in everything there is."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def _appended(frame: DataFrame, label: str) -> DataFrame:
    """Run a stream to its end into files and read them."""
    spark, path = frame.sparkSession, scratch_path(frame.sparkSession, label)
    _drained(
        frame.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    return spark.read.schema(frame.schema).parquet(f"{path}/out")


def _updated(frame: DataFrame, label: str, key: str) -> DataFrame:
    spark, path = frame.sparkSession, scratch_path(frame.sparkSession, label)
    _drained(LS.write_updates(frame, f"{path}/out", f"{path}/state"))
    return LS.latest_updates(spark, f"{path}/out", key)


def _arriving(sf: str, name: str) -> str:
    """A table for a stream to read, be it one file or a folder of them; Spark takes a path that is no pattern for a folder."""
    return f"{sf}/{{{name}}}.parquet"


def _page_stream(spark: SparkSession, sf: str) -> DataFrame:
    return corpora.injected(SS.stream_pages(spark, _arriving(sf, "pages"), glob="*"))


def _log_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = _table(spark, sf, "events").schema
    return L.request_log(spark.readStream.schema(schema).parquet(_arriving(sf, "events")), TICK_MICROS)


@query
def stream_scan(spark, sf):
    """The history table as the streaming scan writes it."""
    path = scratch_path(spark, "stream-scan")
    _drained(SS.stream_history(_page_stream(spark, sf), f"{path}/out", f"{path}/state", ts=1_700_000_000))
    return _codes(history.read_scan_history(spark, f"{path}/out"))


@query
def stream_seen_urls(spark, sf):
    """Every address of two copies of each page, once."""
    doubled = _page_stream(spark, sf).select(F.explode(F.array("url", "url")).alias("url"))
    return _appended(SS.first_sightings(doubled), "stream-seen")


@query
def stream_seen_again(spark, sf):
    """Addresses that arrive in slices of five days, some rows late: one seen again after its state has ended counts anew."""
    path = scratch_path(spark, "stream-again")
    visits = materialize(corpora.late_visits(_table(spark, sf, "events")), "late-visits")
    for part in range(visits.agg(F.max("slice")).first()[0] + 1):
        visits.where(F.col("slice") == part).drop("slice").coalesce(1).write.mode("append").parquet(f"{path}/log")
    stream = spark.readStream.schema(visits.drop("slice").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/log")
    return _appended(SS.first_sightings(stream, "ts", "6 days"), "stream-again").selectExpr("url", "cast(ts AS TIMESTAMP_NTZ) AS seen")


@query
def stream_severity_counts(spark, sf):
    return _updated(SS.running_severity_counts(_page_stream(spark, sf)), "stream-counts", "site")


@query
def stream_rate_grants(spark, sf):
    path = scratch_path(spark, "stream-grants")
    _drained(LS.write_rate_grants(_log_stream(spark, sf).select("host", "id", "t"), 2.0, path, f"{path}/state-of-stream"))
    return LS.read_grants(spark, path).selectExpr("host", "id", "round(granted, 6) AS granted", "round(waited, 6) AS waited")


@query
def stream_adaptive_rates(spark, sf):
    path = scratch_path(spark, "stream-rates")
    _drained(LS.write_adaptive_rates(_log_stream(spark, sf), path, f"{path}/state-of-stream"))
    return LS.current_rates(spark, path).withColumn("current_rate", F.round("current_rate", 6))


@query
def stream_busy_rates(spark, sf):
    """The log folded onto three hosts and fed in slices of time, one per micro-batch, each cut into many chunks."""
    path = scratch_path(spark, "stream-busy")
    log = _log(spark, sf).withColumn("host", F.col("host") % 3)
    span = log.agg(F.max("t")).first()[0] / 4 + 1
    for part in range(4):
        log.where((F.col("t") >= part * span) & (F.col("t") < (part + 1) * span)).coalesce(1).write.mode("append").parquet(f"{path}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/log")
    _drained(LS.write_adaptive_rates(stream, path, f"{path}/state-of-stream", bits=7))
    return LS.current_rates(spark, path).withColumn("current_rate", F.round("current_rate", 6))


# -- scan requests --------------------------------------------------------------------------------------


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return corpora.page_requests(_pages(spark, sf))


@query
def accepted_requests(spark, sf):
    """Scan requests sorted into accepted and rejected, with the id each run gets."""
    return V.with_scan_ids(_requests(spark, sf)).select("url", "valid", F.length("scan_id").alias("id_length"))


@query
def request_results(spark, sf):
    """The final state of a run per accepted request for a page."""
    events = V.run_page_requests(_injected(spark, sf), V.with_scan_ids(_requests(spark, sf)))
    return runs.current_runs(materialize(events, "events")).select(
        "url", "status", "pages_scanned", "total_issues", "error"
    )


@query
def site_request_results(spark, sf):
    """The final state of a run per requested site of the linked snapshot."""
    graph = _graph(spark, sf)
    rules = robots.choose_group(robots.parse_robots(corpora.robots_files(graph)), AGENT)
    listed = robots.parse_sitemap(corpora.sitemap_files(graph))
    asked = V.with_scan_ids(corpora.graph_seeds(graph).selectExpr("url", "timestamp_seconds(1700000000) AS requested_at"))
    events = V.run_site_requests(graph, asked, max_pages=40, robots=rules, sitemap=listed)
    return runs.current_runs(events).select("url", "status", "pages_scanned", "total_issues")


def _served(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """Requests for sites, for every page and for pages that do not exist, served in two batches, one of them twice."""
    graph, inputs = _crawl_inputs(spark, sf)
    at = "timestamp_seconds(1700000000) AS requested_at"
    sites = corpora.graph_requests(graph).selectExpr(
        "request AS request_key", "url", at, "true AS scan_site", "max_pages", "exclude AS exclude_analyzers"
    )
    single = graph.selectExpr(
        "explode(array(struct(1000000 + page_id AS request_key, url), struct(2000000 + page_id AS request_key, "
        "concat('http://nowhere.test/', page_id) AS url))) AS r", "page_id",
    ).selectExpr("r.request_key", "r.url", at, "false AS scan_site", "cast(NULL AS INT) AS max_pages", "array('media') AS exclude_analyzers")
    asked = sites.unionByName(single)
    path = scratch_path(spark, "served")
    again = asked.where("NOT scan_site AND request_key % 2 = 0")
    for batch, rows in (("a", again), ("b", asked.where("scan_site OR request_key % 2 = 1")), ("a", again)):
        run_store.serve_requests(graph, rows, path, batch, **inputs)
    return V.with_scan_ids(asked).select("scan_id", F.col("request_key").alias("request"), "requested_at"), path


@query
def served_runs(spark, sf):
    """What became of every request, and whether its times are in order."""
    asked, path = _served(spark, sf)
    return runs.current_runs(run_store.read_events(spark, path)).join(asked, "scan_id").selectExpr(
        "request", "url", "status", "pages_scanned", "total_issues", "error",
        "requested_at < started_at AND started_at < completed_at AS in_order",
    )


@query
def served_run_pages(spark, sf):
    """The results of the runs, page by page."""
    asked, path = _served(spark, sf)
    return run_store.read_results(spark, path).join(asked, "scan_id").selectExpr(
        "request", "url", "rank", "total", "array_join(transform(issues, i -> concat(i.code, ' ', i.severity)), ',') AS issues",
    )

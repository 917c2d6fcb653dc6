import random
from urllib.parse import urljoin, urlparse

import pytest

from sightline.plans import crawl as G
from sightline.sources import robots as R


def groups_of(spark, text):
    files = spark.createDataFrame([("s", text)], "site string, robots_txt string")
    return R.parse_robots(files)


def chosen(spark, text, agent="my-bot"):
    row = R.choose_group(groups_of(spark, text), agent).first()
    return (row.disallow, row.crawl_delay) if row else None


def test_robots_groups(spark):
    text = "# c\nUser-agent: a\nUser-agent: b\nDisallow: /x\nDisallow:\nCrawl-delay: 2\nCrawl-delay: z\nUser-agent: *\nDisallow: /y # t"
    rows = groups_of(spark, text).orderBy("group_no").collect()
    assert [(r.agents, r.disallow, r.crawl_delay) for r in rows] == [
        (["a"], [], None), (["b"], ["/x", ""], 2.0), (["*"], ["/y # t"], None)]


def test_robots_choice(spark):
    text = "User-agent: *\nDisallow: /star\nUser-agent: BOT\nDisallow: /part\nUser-agent: My-Bot\nDisallow: /own"
    assert chosen(spark, text) == (["/own"], 0.0)
    assert chosen(spark, text, "other-bot") == (["/part"], 0.0)
    assert chosen(spark, text, "nobody") == (["/star"], 0.0)
    assert chosen(spark, "User-agent: x\nDisallow: /") is None
    assert chosen(spark, "") is None
    assert chosen(spark, "Disallow: /orphan") is None
    # stacked agents: the first one stays without rules
    assert chosen(spark, "User-agent: my-bot\nUser-agent: *\nDisallow: /x") == ([], 0.0)


def test_blocking(spark):
    urls = spark.createDataFrame(
        [("s", u) for u in ("http://s", "http://s/a/b", "http://s/ab?x", "http://s/?a", "http://s/b")], "site string, url string")
    rules = spark.createDataFrame([("s", ["", "/a"])], "site string, disallow array<string>")
    rows = {r.url: r.blocked for r in R.blocked_urls(urls, rules).collect()}
    assert rows == {"http://s": False, "http://s/a/b": True, "http://s/ab?x": True, "http://s/?a": False, "http://s/b": False}


def test_sitemap(spark):
    xml = "<urlset><url><loc> http://s/a?b=1&amp;c=2\n</loc></url><LOC x='y'>http://s/b</LOC><location>no</location></urlset>"
    files = spark.createDataFrame([("s", xml), ("t", "")], "site string, sitemap_xml string")
    assert [(r.pos, r.loc) for r in R.parse_sitemap(files).orderBy("pos").collect()] == [
        (0, "http://s/a?b=1&c=2"), (1, "http://s/b")]


def snapshot(spark, sources):
    rows = [(i, url, html) for i, (url, html) in enumerate(sources.items())]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_small_site(spark):
    pages = snapshot(spark, {
        "http://e.test/": '<a href="/about">About</a><img src="x">',
        "http://e.test/about": "<h1>About</h1>",
        "http://e.test/private": "secret",
    })
    files = spark.createDataFrame([("e.test", "User-agent: *\nDisallow: /private\nCrawl-delay: 0")], "site string, robots_txt string")
    xml = "<loc>http://e.test/</loc><loc>http://e.test/private</loc><loc>http://o.test/</loc><loc>http://e.test/gone</loc>"
    maps = spark.createDataFrame([("e.test", xml)], "site string, sitemap_xml string")
    seeds = spark.createDataFrame([("e.test", "http://e.test/")], "site string, url string")
    visits = G.crawl(
        pages, seeds, robots=R.choose_group(R.parse_robots(files), "my-bot"), sitemap=R.parse_sitemap(maps))
    rows = [(r.rank, r.url, r.level, r.outcome) for r in visits.orderBy("rank").collect()]
    assert rows == [
        (1, "http://e.test/", 0, "ok"), (2, "http://e.test/private", 0, "blocked"),
        (3, "http://e.test/gone", 0, "failed"), (4, "http://e.test/about", 1, "ok")]
    scanned = {r.url: r for r in G.scan_visits(pages, visits).collect()}
    assert scanned["http://e.test/"].issues[0].code == "IMG_MISSING_ALT"
    assert scanned["http://e.test/gone"].total == 0 and scanned["http://e.test/gone"].issues is None
    progress = [(r.level, r.visited, r.scanned) for r in G.crawl_progress(visits).orderBy("level").collect()]
    assert progress == [(0, 3, 3), (1, 1, 4)]


def first_in_first_out(pages, start, listed, blocked, cap, keep):
    """The crawl as a queue, one address at a time."""
    host = urlparse(start).netloc
    queue = [start] + [u for u in listed if urlparse(u).netloc == host]
    seen, out = set(), []
    while queue and len(seen) < cap:
        url = queue.pop(0)
        if url in seen:
            continue
        seen.add(url)
        if any(b and (urlparse(url).path or "/").startswith(b) for b in blocked):
            out.append((url, "blocked"))
            continue
        links = pages.get(url.split("#")[0])
        out.append((url, "ok" if links is not None else "failed"))
        for href in links or []:
            full = urljoin(url, href)
            full = full if keep else full.split("#")[0]
            if urlparse(full).netloc == host and full not in seen and full not in queue:
                queue.append(full)
    return out


@pytest.mark.parametrize("seed,cap,keep", [(1, 12, False), (2, 30, True), (3, 500, False)])
def test_agrees_with_a_queue(spark, seed, cap, keep):
    random.seed(seed)
    graph, html = {}, {}
    for host in ("a.test", "b.test:81"):
        for n in range(25):
            hrefs = [random.choice([
                f"/{random.randrange(30)}", f"{random.randrange(30)}#x", f"http://{host}/{random.randrange(30)}",
                "http://else.test/1", "mailto:x", f"/no/{random.randrange(5)}", "?q", ""]) for _ in range(4)]
            url = f"http://{host}/{n}"
            graph[url] = hrefs
            html[url] = "".join(f'<a href="{h}">x</a>' for h in hrefs) + "<a>none</a>"
    seeds, listed, want = [], [], []
    for host in ("a.test", "b.test:81"):
        locs = [f"http://{host}/{random.randrange(25)}" for _ in range(3)] + ["http://else.test/2"]
        seeds.append((host, f"http://{host}/0"))
        listed += [(host, i, loc) for i, loc in enumerate(locs)]
        steps = first_in_first_out(graph, f"http://{host}/0", locs, ["/1", ""], cap, keep)
        want += [(host, i + 1, url, outcome) for i, (url, outcome) in enumerate(steps)]
    visits = G.crawl(
        snapshot(spark, html), spark.createDataFrame(seeds, "site string, url string"), max_pages=cap, keep_fragment=keep,
        robots=spark.createDataFrame([(h, ["/1", ""]) for h, _ in seeds], "site string, disallow array<string>"),
        sitemap=spark.createDataFrame(listed, "site string, pos int, loc string"),
    )
    got = [(r.site, r["rank"], r.url, r.outcome) for r in visits.collect()]
    assert sorted(got) == sorted(want)


def queue_log(pages, start, listed, cap):
    """What a crawler reports after each fetched page: (visited, found, address)."""
    host = urlparse(start).netloc
    queue = [start] + [u for u in listed if urlparse(u).netloc == host]
    seen, found, log = set(), len(queue), []
    while queue and len(seen) < cap:
        url = queue.pop(0)
        if url in seen:
            continue
        seen.add(url)
        if url not in pages:
            continue
        log.append((len(seen), found, url))
        for href in pages[url]:
            full = urljoin(url, href).split("#")[0]
            if urlparse(full).netloc == host and full not in seen and full not in queue:
                queue.append(full)
                found += 1
    return log


def test_requests_are_crawls_of_their_own(spark, monkeypatch, tmp_path):
    from sightline.operators import dom
    from sightline.operators.rules import RuleSet, default_rules
    from sightline.sources import history as H

    monkeypatch.setattr(G, "CHUNK_BITS", 2)
    draw = random.Random(11)
    hosts = ("a.test", "b.test")
    links = {
        f"http://{h}/{n}": [draw.choice([f"/{draw.randrange(24)}", f"http://{h}/{draw.randrange(24)}#f", f"/no/{draw.randrange(4)}", "http://c.test/"])
                            for _ in range(3)]
        for h in hosts for n in range(20)
    }
    html = {u: "".join(f'<a href="{x}">t</a>' for x in hrefs) + "<img>" * (k % 3) for k, (u, hrefs) in enumerate(links.items())}
    pages = snapshot(spark, html)
    listed = {h: [f"http://{h}/{draw.randrange(20)}" for _ in range(3)] for h in hosts}
    asked = [
        ("r1", "a.test", "http://a.test/0", 9, None), ("r2", "a.test", "http://a.test/7", None, ["alt_text"]),
        ("r3", "b.test", "http://b.test/3", 14, []), ("r4", "b.test", "http://b.test/nowhere", 2, None),
    ]
    seeds = spark.createDataFrame(asked, "request string, site string, url string, max_pages int, exclude array<string>")
    sitemap = spark.createDataFrame([(h, k, u) for h in hosts for k, u in enumerate(listed[h])], "site string, pos int, loc string")

    index = G.materialize(G.page_index(pages, seeds, scan=True), "index-test")
    visits = G.crawl(index, seeds, sitemap=sitemap, links=True)
    got = {(r.request, r["rank"], r.url, r.outcome) for r in visits.collect()}
    want, logs = set(), set()
    for request, site, start, cap, _ in asked:
        steps = first_in_first_out(links, start, listed[site], [], cap or 10**9, False)
        want |= {(request, k + 1, url, outcome) for k, (url, outcome) in enumerate(steps)}
        logs |= {(request, *row) for row in queue_log(links, start, listed[site], cap or 10**9)}
    assert got == want
    assert {(r.request, r.scanned, r.found, r.url) for r in G.page_progress(visits, seeds, sitemap).collect()} == logs

    path, parses = str(tmp_path / "scans"), []
    parse = dom.with_dom
    monkeypatch.setattr(G, "with_dom", lambda *a, **k: parses.append(1) or parse(*a, **k))
    rules = RuleSet([r for r in default_rules().active() if r.name == "alt_text"])
    scanned = G.scan_to_history(pages, seeds, path, 5, "one", rules=rules, sitemap=sitemap)
    G.scan_to_history(pages, seeds, path, 5, "one", rules=rules, sitemap=sitemap)
    assert len(parses) == 2
    images = {u: h.count("<img>") for u, h in html.items()}
    for r in scanned.collect():
        assert r.total == (images[r.url] if r.outcome == "ok" and r.request != "r2" else 0)
        assert (r.issues is None) == (r.outcome != "ok")
    stored = [(r.site, r.url, len(r.issues)) for r in H.read_scan_history(spark, path).collect()]
    first = {}
    for request, _, url, outcome in sorted(want):
        if outcome == "ok":
            first.setdefault(url, 0 if request == "r2" else images[url])
    assert sorted(stored) == sorted((urlparse(u).netloc, u, n) for u, n in first.items())


def test_a_scan_parses_once_and_keeps_markup_in_its_task(spark):
    pages = snapshot(spark, {"http://e.test/": "<img>"})
    seeds = spark.createDataFrame([("e.test", "http://e.test/")], "site string, url string")
    plan = G.page_index(pages, seeds, scan=True)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line or "MapInArrow" in line]
    assert sum("MapInArrow" in line for line in exchanges) == 1 and not any("html" in line for line in exchanges if "Exchange hash" in line)


@pytest.mark.parametrize("keep", [False, True])
def test_a_long_chain_is_one_search_not_a_level_each(spark, monkeypatch, keep):
    levels, told = [], []
    accept = G._accept
    monkeypatch.setattr(G, "_accept", lambda *a: levels.append(1) or accept(*a))
    start = "http://e.test/0"
    links = {f"http://e.test/{n}": [f"/{n + 1}#x", f"/{n - 9}", f"/private/{n}", "/0"] for n in range(30)}
    html = {u: "".join(f'<a href="{x}">t</a>' for x in hrefs) for u, hrefs in links.items()}
    listed = ["http://e.test/4#top", "http://e.test/0", "http://o.test/"]
    visits = G.crawl(
        snapshot(spark, html), spark.createDataFrame([("e.test", start)], "site string, url string"), max_pages=None, keep_fragment=keep,
        robots=spark.createDataFrame([("e.test", ["/private"])], "site string, disallow array<string>"),
        sitemap=spark.createDataFrame([("e.test", i, u) for i, u in enumerate(listed)], "site string, pos int, loc string"),
        on_level=lambda *a: told.append(a),
    )
    rows = visits.orderBy("rank").collect()
    want = first_in_first_out(links, start, listed, ["/private"], 10**9, keep)
    assert [(r.url, r.outcome) for r in rows] == want and [r["rank"] for r in rows] == list(range(1, len(want) + 1))
    by_level = [sum(r.level <= k for r in rows) for k in range(max(r.level for r in rows) + 1)]
    assert told == list(enumerate(by_level)) and len(told) > 20
    assert not levels


@pytest.mark.parametrize("size,number", [(80, "xxhash64({})"), (1 << 23, "length({})")])
def test_large_and_unclear_sites_go_by_levels(spark, monkeypatch, size, number):
    monkeypatch.setattr(G, "WALK_LINKS", size)
    monkeypatch.setattr(G, "ADDRESS_ID", number)
    monkeypatch.setattr(G, "CHUNK_BITS", 2)
    draw = random.Random(5)
    sizes = {"a.test": 8, "b.test": 30, "c.test": 14}
    links = {f"http://{h}/{n}": [f"/{draw.randrange(n + 4)}" for _ in range(3)] + [f"/{n + 1}"] for h, m in sizes.items() for n in range(m)}
    html = {u: "".join(f'<a href="{x}">t</a>' for x in hrefs) for u, hrefs in links.items()}
    asked = [(n, h, f"http://{h}/{n % 3}", None if n % 2 else 5 + n) for n, h in enumerate(["a.test", "b.test", "c.test", "a.test"] * 2)]
    # One that starts on another site than its own, and one with two starts.
    asked += [(50, "a.test", "http://b.test/7", None), (51, "c.test", "http://c.test/0", None), (51, "c.test", "http://c.test/3", 6)]
    seeds = spark.createDataFrame(asked, "request long, site string, url string, max_pages int")
    told = []
    visits = G.crawl(snapshot(spark, html), seeds, on_level=lambda *a: told.append(a)).collect()
    for request, _, start, cap in asked[:-2]:
        got = [(r.url, r.outcome) for r in sorted(visits, key=lambda r: r["rank"]) if r.request == request]
        assert got == first_in_first_out(links, start, [], [], cap or 10**9, False)
    assert told == [(k, sum(r.level <= k for r in visits)) for k in range(len(told))] and told[-1][1] == len(visits)
    both = [r for r in visits if r.request == 51]
    assert {r.url for r in both if r.level == 0} == {"http://c.test/0", "http://c.test/3"}


def test_a_request_twice_visits_twice(spark, monkeypatch):
    pages = snapshot(spark, {"http://e.test/": '<a href="/1">t</a><a href="/2">t</a>', "http://e.test/1": '<a href="/3">t</a>'})
    rows = [("r", "e.test", "http://e.test/", 7)] * 2 + [("s", "e.test", "http://e.test/1", None), (None, "e.test", "http://e.test/", None)]
    seeds = spark.createDataFrame(rows, "request string, site string, url string, max_pages int")
    want = {("r", k + 1, f"http://e.test/{n or ''}") for k, n in enumerate([0, 0, 1, 1, 2, 2, 3])}
    want |= {("s", 1, "http://e.test/1"), ("s", 2, "http://e.test/3")}
    for size in (1 << 23, 0):
        monkeypatch.setattr(G, "WALK_LINKS", size)
        got = [(r.request, r["rank"], r.url) for r in G.crawl(pages, seeds).collect()]
        assert len(got) == len(want) and set(got) == want


def test_walk_over_cut_batches(monkeypatch):
    import pyarrow as pa

    from sightline.operators import walk as W

    monkeypatch.setattr(W, "ROW_IDS", 3)
    draw, rows, want = random.Random(3), [], {}
    for name, size in (("a", 40), ("b", 1), ("c", 17)):
        graph = {n * 7 - 50: [draw.randrange(size + 5) * 7 - 50 for _ in range(draw.randrange(4))] + [n * 7 - 43] for n in range(size)}
        for bucket in (0, 1):
            rows += [(name, bucket, W.PAGE, n, ids, None, None, None) for n, ids in graph.items()]
            rows.append((name, bucket, W.ALIAS, 10**6, [-50], None, None, None))
            for k, cap in enumerate((None, 9, 0)):
                starts = [10**6, -50, 10**9] if k else [-50]
                rows.append((name, bucket, W.REQUEST, None, starts, f"{name}{bucket}{k}", cap, 2))
                queue = list(starts)
                for n in queue:
                    queue += dict.fromkeys(t for t in graph.get(-50 if n == 10**6 else n, []) if t not in queue)
                want[f"{name}{bucket}{k}"] = queue if cap is None else queue[:-(-cap // 2)]
    schema = pa.schema([
        ("site", pa.string()), ("bucket", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("ids", pa.list_(pa.int64())),
        ("request", pa.string()), ("max_pages", pa.int64()), ("copies", pa.int64())])
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)]
    cut = pa.RecordBatch.from_arrays(columns, schema=schema)
    out = [r for b in W.walk(cut.slice(k, 11) for k in range(0, cut.num_rows, 11)) for r in b.to_pylist()]
    assert max(len(r["ids"]) for r in out) == 3 and len({r["level"] for r in out}) > 5
    got = {k: [] for k in want}
    for r in out:
        assert r["first"] == len(got[r["request"]]) and r["site"] == r["request"][0] and r["copies"] == 2
        got[r["request"]] += r["ids"]
    assert got == want

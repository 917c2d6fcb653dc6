import random
import time
import tracemalloc

from sightline.operators import nodes as N
from sightline.operators.dom import with_dom
from sightline.operators.html_tree import Page
from sightline.operators.rules import default_rules, issue_rows, page_issues, page_totals

DEEP = 50_000


def ancestors(page, i):
    while page.parent[i] >= 0:
        i = page.parent[i]
        yield i


def test_containment_against_parents(spark, pages_of):
    draw = random.Random(8)
    parts = ["<div>", "</div>", "<label>", "</label>", "<span>", "</span>", "<img>", "x", "<table>", "<tr>", "<td>", "</table>"]
    sources = ["".join(draw.choice(parts) for _ in range(draw.randrange(60))) for _ in range(300)]
    doms = with_dom(pages_of(*sources))
    images = "filter(dom, e -> e.tag = 'img')"
    labels = "filter(dom, e -> e.tag = 'label')"
    shared = doms.selectExpr(
        "page_id", "dom", f"{N.following(images)} AS images_from", f"{N.before(N.ids(labels))} AS begun",
        f"{N.before(f'array_sort(transform({labels}, e -> e.subtree_end))')} AS ended", f"size({labels}) AS n",
    )
    facts = (
        f"transform(dom, e -> struct({N.holds('images_from')} AS one, {N.holds_two('images_from')} AS two, "
        f"{N.first_in('images_from')} AS first, {N.inside('begun', 'ended', 'n')} AS inside))"
    )
    for row in shared.selectExpr("page_id", f"{facts} AS facts").collect():
        page = Page(sources[row.page_id])
        inside = [[] for _ in page.tag]
        for i, tag in enumerate(page.tag):
            if tag == "img":
                for owner in ancestors(page, i):
                    inside[owner].append(i)
        expected = [
            (len(own) > 0, len(own) > 1, own[0] if own else None, any(page.tag[a] == "label" for a in ancestors(page, i)))
            for i, own in enumerate(inside)
        ]
        assert [tuple(f) for f in row.facts] == expected


def test_descendants_as_a_relation(spark, pages_of):
    sources = ["<table><tr><td><a href=x><b>t</b></a><table><tr><td>1</table></table>", "<div role=x><p aria-hidden=true><img></p></div>"]
    got = N.descendants(with_dom(pages_of(*sources)), facts=("tag", "depth"))
    assert got.columns == ["page_id", "url", "container_id", "node_id", "tag", "depth"]
    expected = set()
    for n, source in enumerate(sources):
        page = Page(source)
        for i in range(len(page.tag)):
            for owner in ancestors(page, i):
                if page.tag[owner] in N.CONTAINER_TAGS or {"role", "aria-hidden"} & set(page.attrs[owner]):
                    expected.add((n, owner, i, page.tag[i], page.depth[i]))
    assert {(r.page_id, r.container_id, r.node_id, r.tag, r.depth) for r in got.collect()} == expected


def test_deep_nesting_is_linear(spark, pages_of):
    deep = "<div role=x aria-hidden=true>" * DEEP + "<a href=y>t</a>"
    tracemalloc.start()
    started = time.perf_counter()
    Page(deep)
    taken = time.perf_counter() - started
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3000 * DEEP and taken < 30
    started = time.perf_counter()
    pages = pages_of(deep, "<div role=x aria-hidden=true>" * 3 + "<a href=y>t</a>")
    found = issue_rows(page_issues(with_dom(pages), default_rules()).select("page_id", "issues"))
    counts = {(r.page_id, r.code): r["count"] for r in found.groupBy("page_id", "code").count().collect()}
    assert time.perf_counter() - started < 60
    for page_id, n in ((0, DEEP), (1, 3)):
        assert counts[page_id, "INVALID_ARIA_ROLE"] == counts[page_id, "ARIA_HIDDEN_FOCUSABLE"] == n
    # Everything else about the deep page is as on the shallow one.
    assert {k[1]: v for k, v in counts.items() if k[0] == 0 and v < 10} == {k[1]: v for k, v in counts.items() if k[0] == 1 and v != 3}
    totals = {r.page_id: r.total for r in page_totals(with_dom(pages, markup=False)).collect()}
    assert totals == {p: sum(v for k, v in counts.items() if k[0] == p) for p in (0, 1)}

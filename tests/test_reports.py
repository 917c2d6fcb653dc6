import json
import pathlib

import pytest
from pyspark.sql import functions as F

from sightline.operators import fixes as X, summaries as A
from sightline.operators.dom import with_dom
from sightline.operators.html_tree import Page
from sightline.operators.rules import issue_rows
from sightline.plans import report as P
from sightline.plans.scan import scan_pages

PAGE = '<html lang="en"><head><title>T</title></head><body><main><h1>H</h1>{}</main></body></html>'


@pytest.fixture(scope="module")
def scanned(pages_of):
    return scan_pages(pages_of(
        PAGE.format('<img src="<1>"><h4>x</h4>'),
        PAGE.format(""),
        PAGE.format('<img src=a><img src=b><p style="color:#777;background:#fff">t</p>'),
    ))


def test_enrich_keeps_unknown_codes_and_other_columns(spark):
    issues = spark.createDataFrame([("IMG_MISSING_ALT", "m"), ("NEW", "n"), (None, "o")], "code string, message string")
    rows = {r.message: r for r in A.enrich(issues).collect()}
    assert (rows["m"].severity, rows["m"].wcag, rows["m"].wcag_name) == ("critical", "1.1.1", "Non-text Content")
    assert (rows["n"].severity, rows["n"].wcag, rows["n"].impact) == ("minor", None, None)
    assert rows["o"].severity == "minor"
    plan = A.enrich(issues)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_summaries(spark):
    levels = ["critical"] * 2 + ["major"] + ["minor"] * 2 + ["odd", None]
    issues = spark.createDataFrame([(s, "c") for s in levels] + [("minor", None)], "severity string, code string")
    assert tuple(A.summarize_by_severity(issues).first()) == (2, 1, 5)
    assert tuple(A.summarize_by_severity(issues.limit(0)).first()) == (0, 0, 0)
    assert {r.code: r.n for r in A.summarize_by_code(issues).collect()} == {"c": 7, "UNKNOWN": 1}
    ordered = [r.severity for r in A.sort_by_severity(issues, "code").collect()]
    assert ordered[:3] == ["critical", "critical", "major"]


def test_counts_add_up(scanned):
    rows = scanned.collect()
    assert [(r.total, r.critical, r.major, r.minor) for r in rows] == [(2, 1, 0, 1), (0, 0, 0, 0), (3, 2, 1, 0)]
    totals = {r.level: r for r in A.page_and_site_totals(scanned).collect() if r.level != "page"}
    assert totals["site"].issues == totals["all"].issues == 5
    assert issue_rows(scanned).count() == 5


def test_overview_ranks_pages(scanned):
    rows = P.page_overview(scanned).collect()
    assert [r.page_id for r in rows] == [2, 0, 1]
    assert [r.status_class for r in rows] == ["danger", "danger", "success"]
    assert rows[0].anchor == "http---a-test-2"


def test_details_are_sorted_and_escaped(scanned):
    rows = P.issue_details(scanned).where("page_id = 0").orderBy("place").collect()
    assert [r.code for r in rows] == ["IMG_MISSING_ALT", "HEADING_ORDER"]
    assert rows[0].badge == "🔴 CRITICAL" and rows[0].context == "&lt;img src=&quot;&amp;lt;1&amp;gt;&quot;/&gt;"
    assert P.page_report(scanned, "http://a.test/2").count() == 3


def test_headers_and_console(scanned):
    header = P.site_header(scanned, "now", "A & B").first()
    assert (header.title, header.total_pages, header.total_issues) == ("A &amp; B", 3, 5)
    assert json.loads(header.chart_data) == {"critical": 3, "major": 1, "minor": 1}
    assert header.chart_data == '{"critical": 3, "major": 1, "minor": 1}'
    lines = [r.line for r in P.console_pages(scanned).collect()]
    assert lines[0] == "  ⚠️ http://a.test/0: 2 issues" and lines[1].startswith("  ✅")
    assert [r.code for r in P.top_issues(scanned, 2).collect()] == ["IMG_MISSING_ALT"] * 2
    assert P.issues_beyond(scanned, 2).first().more == 3


def test_site_report_files(scanned, tmp_path):
    P.write_site_report(scanned, str(tmp_path / "report"), "now", "Title <x>")
    folder = tmp_path / "report" / "site=a.test"
    text = "".join(f.read_text() for f in sorted(folder.glob("part-*")))
    assert text.startswith("<!DOCTYPE html>") and text.rstrip().endswith("</html>")
    assert "Title &lt;x&gt;" in text and text.index("http://a.test/2</a>") < text.index("http://a.test/0</a>")
    assert text.count("<section") == 2 and text.count("<tr class=\"severity-") == 5
    page = Page(text)
    assert page.tag.count("table") == 3 and page.tag.count("section") == 2


def test_json_report(scanned, tmp_path):
    P.write_json_report(A.nested_report(scanned, "9"), str(tmp_path / "json"))
    records = [json.loads(line) for f in pathlib.Path(tmp_path / "json").glob("*.json") for line in f.open()]
    found = {r["url"]: r for r in records}
    assert found["http://a.test/2"]["summary"] == {"IMG_MISSING_ALT": 2, "LOW_CONTRAST": 1}
    assert found["http://a.test/1"]["issues"] == [] and found["http://a.test/1"]["version"] == "9"
    assert found["http://a.test/0"]["severity_summary"] == {"critical": 1, "major": 0, "minor": 1}


# -- fixes -----------------------------------------------------------------------------------------


def test_fixes(pages_of, spark):
    pages = pages_of(
        '<!DOCTYPE html><html><body><img src="/images/logo.png"/><p class="a  b" style="color: #777777; '
        'background-color: #ffffff;">t<img id=i1></p></body></html>',
        '<p style="color:rgb(1,2);background:#fff">x</p>',
        "<img src=k.png alt=\" \" style=\"background:#000;color:#111\" title='a\"b'>",
        '<p style="color:white;background:#fff">named colours are not read</p>',
    )
    rows = {r.page_id: r for r in X.apply_fixes(pages).collect()}
    assert rows[0].fixed_html == (
        '<!DOCTYPE html>\n<html><body><img src="/images/logo.png" alt="logo.png"/><p class="a b" '
        'style="color: #000000;  background-color: #ffffff">t<img id="i1" alt="image"/></p></body></html>'
    )
    assert [(f.code, f.fix) for f in rows[0].applied] == [
        ("IMG_MISSING_ALT", "set alt='logo.png'"), ("IMG_MISSING_ALT", "set alt='image'"),
        ("LOW_CONTRAST", "set color=#000000"),
    ]
    assert rows[0].applied[2].context.endswith('t<img id="i1" alt="image"/></p>')
    assert rows[1].fixed_html is None and rows[1].applied == [] and rows[1].fix_error
    assert "color: #ffffff" in rows[2].fixed_html and "title='a\"b'" in rows[2].fixed_html
    assert rows[3].applied == []

    looked_up = spark.createDataFrame([("i1", "Eye"), ("k.png", "Kay")], "key string, alt string")
    for lookup in ({"i1": "Eye", "k.png": "Kay"}, looked_up):
        rows = {r.page_id: r for r in X.apply_fixes(pages, lookup).collect()}
        assert 'id="i1" alt="Eye"' in rows[0].fixed_html and 'alt="Kay"' in rows[2].fixed_html


def test_fixing_twice_changes_nothing(pages_of):
    pages = pages_of(PAGE.format('<img src="x/y.png"><b style="color:#aaa;background:#bbb">q</b>'))
    once = X.apply_fixes(pages)
    twice = X.apply_fixes(once.selectExpr("page_id", "url", "fixed_html AS html"))
    assert twice.first().applied == [] and twice.first().fixed_html == once.first().fixed_html


def test_long_contexts_match_the_rewritten_page(pages_of):
    inner = "".join(f"<i>{n}</i><img src={n}.png>" for n in range(40))
    pages = pages_of(PAGE.format(f'<div style="color:#777;background:#fff">{inner}</div>after'))
    row = X.apply_fixes(pages).first()
    start = row.fixed_html.index("<div style")
    assert row.applied[-1].context == row.fixed_html[start:start + 200]
    short = X.apply_fixes(pages_of(PAGE.format('<div style="color:#777;background:#fff"><img src=a></div>after'))).first()
    assert short.applied[-1].context == '<div style="color: #000000; background:#fff"><img src="a" alt="a"/></div>'


def test_fix_outputs(pages_of, tmp_path, spark):
    fixed = X.apply_fixes(pages_of(*[PAGE.format("<img src=a>" * 12)] * 2))
    report = X.fix_report(fixed).first()
    assert report.n == 12 and len(report.lines) == 10 and report.lines[0] == "   - IMG_MISSING_ALT: set alt='a'"
    assert X.fix_summary(fixed).first().n == 24
    X.write_fixed_html(fixed, str(tmp_path / "table"))
    assert {r.fname for r in spark.read.parquet(str(tmp_path / "table")).collect()} == {
        "http_a.test_0.html", "http_a.test_1.html"}
    X.write_fixed_html(fixed, str(tmp_path / "files"), file_per_page=True)
    one = next((tmp_path / "files" / "fname=http_a.test_0.html").glob("part-*"))
    assert one.read_text() == fixed.where("page_id = 0").first().fixed_html + "\n"


def test_prompts(pages_of):
    pages = pages_of(PAGE.format("<img src=a>") + "z" * 9000)
    kept = with_dom(pages.withColumn("source", F.col("html")))
    from sightline.operators.rules import page_issues

    row = X.suggestion_prompts(page_issues(kept).withColumnRenamed("source", "html")).first()
    head, html = row.prompt.split("HTML snippet (truncated):\n")
    assert len(html) == 4000 and '"code":"IMG_MISSING_ALT"' in head


def test_site_documents_in_shared_files(spark, pages_of, tmp_path):
    sites = {f"http://s{n:02}.test": n % 4 + 1 for n in range(12)} | {"http://big.test": 300}
    pages = None
    for k, (site, n) in enumerate(sites.items()):
        rows = pages_of(*[PAGE.format("<img src=a>" * (i % 3)) for i in range(n)], site=site).withColumn("page_id", F.col("page_id") + 1000 * k)
        pages = rows if pages is None else pages.unionByName(rows)
    odd = pages_of('<p style="color:rgb(1,2);background:#fff">"x"</p>', site='http://odd.test/"q"').withColumn("page_id", F.lit(-1).cast("long"))
    pages = pages.unionByName(odd)
    scanned = scan_pages(pages)
    path = str(tmp_path / "documents")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        P.write_documents(P.site_document(scanned, X.apply_fixes(pages)), ["part", "page_id"], path)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    index = P.document_index(spark, path).collect()
    files = {}
    for r in index:
        files.setdefault(r.site, []).append(r.file)
    assert len(files["big.test"]) > 1 and len({r.file for r in index}) <= int(before) < len(files)
    whole = {}
    for r in P.read_documents(spark, path).orderBy("site", "n").collect():
        whole.setdefault(r.site, []).append((r.n, r.line))
    assert whole.keys() == files.keys()
    totals = {r.url: r for r in scanned.collect()}
    for site, lines in whole.items():
        assert [n for n, _ in lines] == list(range(len(lines)))
        assert [r.line for r in P.read_document(spark, path, site).collect()] == [line for _, line in lines]
        report = json.loads("".join(line for _, line in lines))
        own = {u: r for u, r in totals.items() if r.site == site}
        assert report["pages"].keys() == own.keys() and report["version"] == "1"
        assert report["severity_summary"] == {c: sum(r[c] for r in own.values()) for c in ("critical", "major", "minor")}
        for url, entry in report["pages"].items():
            assert len(entry["issues"]) == own[url].total == sum(entry["summary"].values())
            if site == "odd.test":
                assert entry["fixed_error"] and "fixed_fixes" not in entry
            else:
                assert entry["fixed_html_snippet"].count("alt=") == len(entry["fixed_fixes"]) == entry["summary"].get("IMG_MISSING_ALT", 0)


def test_edits_apply_and_undo(pages_of):
    sources = ['<p>é<img src=a><img src="a" alt=" "><p style="color:#777;background:#fff">x</p>', "<p>plain", "", None,
               '<img style="color:#777;background-color:#fff">', '<img src=b><p style="color:rgb(1,2);background:#fff">x']
    fixed = X.apply_fixes(pages_of(*sources), {"a": 'say "é" 😀'}, edits=True).select(
        "*", X.spliced("parsed_html", "edits").alias("again"), X.spliced("fixed_html", "edits", undo=True).alias("back"))
    rows = {r.page_id: r for r in fixed.collect()}
    assert [len(rows[k].edits) for k in range(6)] == [3, 0, 0, 0, 1, 0]
    for k, r in rows.items():
        if r.fix_error is None:
            assert (r.again, r.back) == (r.fixed_html, r.parsed_html)
        for e in r.edits:
            assert r.parsed_html[e.at : e.at + len(e.old)] == e.old
    # Both fixes of one start tag are one edit, and a page that cannot be read is left as it is.
    assert len(rows[4].applied) == 2 and rows[5].fixed_html is None and rows[5].back is None and rows[5].again == rows[5].parsed_html
    assert [(r.page_id, r.pos) for r in X.edit_rows(fixed.drop("again", "back")).orderBy("page_id", "pos").collect()] == [(0, 0), (0, 1), (0, 2), (4, 0)]
    with pytest.raises(Exception, match="does not fit"):
        fixed.where("page_id = 0").select(X.spliced("fixed_html", "edits")).collect()

"""Rules on small pages: exact issues, in order."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sightline.operators import rules as R
from sightline.operators.dom import elements, with_dom
from sightline.plans.scan import scan_issues, scan_pages

VALID = (
    '<html lang="en"><head><title>T</title></head><body><a href="#main">Skip to main</a><nav></nav>'
    '<main id="main"><h1>H</h1>{}</main></body></html>'
)
MISSING = ["MISSING_LANG", "MISSING_TITLE", "MISSING_MAIN", "MISSING_H1"]

# markup placed in a valid page, the codes it gives rise to
PLACED = [
    ("", []),
    ('<img src="logo.png"/>', ["IMG_MISSING_ALT"]),
    ('<img alt="">', ["IMG_MISSING_ALT"]),
    ('<img alt="&nbsp;">', ["IMG_MISSING_ALT"]),
    ('<img alt="x">', []),
    ('<a href="/"> </a>', ["LINK_NO_TEXT"]),
    ('<a href="/" title=" ">&nbsp;</a>', ["LINK_NO_TEXT"]),
    ('<a href="/" aria-label="x"></a>', []),
    ('<a><img alt="x"></a>', []),
    ('<a><img alt="x"><img></a>', ["IMG_MISSING_ALT"]),
    ('<a><img><img alt="x"></a>', ["IMG_MISSING_ALT", "LINK_IMG_MISSING_ALT"]),
    ('<a><span><img></span></a>', ["IMG_MISSING_ALT", "LINK_IMG_MISSING_ALT"]),
    ('<input type="text" id="name"/>', ["FORM_CONTROL_NO_LABEL"]),
    ('<label for="name">N</label><input id="name">', []),
    ('<label for="">N</label><input id="">', ["FORM_CONTROL_NO_LABEL"]),
    ('<label>N <span><input></span></label>', []),
    ('<input title=" "><textarea aria-label="x"></textarea><select aria-labelledby="y"></select>', []),
    ('<input type="HIDDEN"><input type="image"><input type="reset" value="r">', []),
    ("<h2>a</h2><h3>b</h3>", []),
    ("<h3>a</h3><h6>b</h6>", ["HEADING_ORDER"]),
    ("<h2>a</h2><h1>b</h1>", ["MULTIPLE_H1"]),
    ('<p style="color: #777777; background-color: #ffffff">t</p>', ["LOW_CONTRAST"]),
    ('<p style="COLOR:#777;Background:WHITE">t</p>', ["LOW_CONTRAST"]),
    ('<p style="color:#777;background:#fff;color:#000">t</p>', []),
    ('<p style="color:#777;background:#fff;background:url(x)">t</p>', []),
    ('<p style="color:#7777;background:#fff">t</p>', []),
    ("<button></button>", ["BUTTON_NO_TEXT"]),
    ("<button>Go</button>", []),
    ('<button aria-label="Go"></button>', []),
    ('<button><img alt="Go"></button>', []),
    ('<button><img alt=""><img alt="Go"></button>', ["IMG_MISSING_ALT", "BUTTON_NO_TEXT"]),
    ('<input type="button"/>', ["BUTTON_NO_TEXT"]),
    ('<input type="Button" title="t">', []),
    ('<input type="submit">', []),
    ('<input type="submit" value="">', ["BUTTON_NO_TEXT"]),
    ('<input type="submit" value=" ">', []),
    ('<div role="button"></div>', ["BUTTON_NO_TEXT"]),
    ('<div role="Button"></div>', []),
    ('<button role="button"></button>', ["BUTTON_NO_TEXT", "BUTTON_NO_TEXT"]),
    ("<table><tr><td>1</td></tr></table>", []),
    ("<table><tr><td>1</td></tr><tr><td>2</td></tr></table>", ["TABLE_NO_HEADERS", "TABLE_NO_CAPTION"]),
    ('<table><caption></caption><tr><th scope="col">1</th></tr><tr><td>2</td></tr></table>', []),
    ('<table summary="s"><tr><th>1</th></tr><tr><th scope="row">2</th></tr></table>', ["TABLE_MISSING_SCOPE"]),
    ('<table role="PRESENTATION"><tr></tr><tr></tr></table>', []),
    ("<table aria-label=o><tr><td><table aria-label=i><tr><th>1</th></tr></table></td></tr></table>", []),
    ("<table aria-label=o><tr><td><table aria-label=i><tr></tr><tr></tr></table></td></tr></table>",
     ["TABLE_NO_HEADERS", "TABLE_NO_HEADERS"]),
    ('<div role="foobar">x</div>', ["INVALID_ARIA_ROLE"]),
    ('<div role=" Tab ">x</div><div role="">x</div>', []),
    ('<div role="tab list">x</div>', ["INVALID_ARIA_ROLE"]),
    ('<button aria-hidden="true">x</button>', ["ARIA_HIDDEN_FOCUSABLE"]),
    ('<a href="/" aria-hidden="true">x<b tabindex="0">y</b></a>', ["ARIA_HIDDEN_FOCUSABLE", "ARIA_HIDDEN_FOCUSABLE"]),
    ('<div aria-hidden="true"><b tabindex="-1">y</b><a>z</a><input disabled aria-label=x></div>', []),
    ('<div aria-hidden="true" tabindex=" +1 "></div>', ["ARIA_HIDDEN_FOCUSABLE"]),
    ('<div aria-hidden="true"><b tabindex="x" contenteditable="true">y</b></div>', ["ARIA_HIDDEN_FOCUSABLE"]),
    ('<div aria-hidden="TRUE"><button>y</button></div>', []),
    ('<video src="v"></video>', ["VIDEO_NO_CAPTIONS"]),
    ('<video><track kind="captions"></video><video><track kind="subtitles"></video>', []),
    ('<video><track kind="Captions"></video>', ["VIDEO_NO_CAPTIONS"]),
    ('<video autoplay><track kind="captions"></video>', ["AUTOPLAY_NO_CONTROLS"]),
    ('<video autoplay muted><track kind="captions"></video><audio autoplay controls></audio>', []),
    ("<audio autoplay></audio>", ["AUTOPLAY_NO_CONTROLS"]),
]
# whole pages
WHOLE = [
    ("", ["MISSING_TITLE", "MISSING_MAIN", "MISSING_H1"]),
    ("<html></html>", MISSING),
    ('<html lang="xyz"><title>t</title><main><h1>h</h1></main>', ["INVALID_LANG"]),
    ('<html lang="en-US"><title>t</title><div role="main"><h1>h</h1></div>', []),
    ('<html lang="en_US"><title>t</title><main><h1>h</h1></main>', ["INVALID_LANG"]),
    ('<html lang=" "><title> </title><main><h1>h</h1></main>', ["MISSING_LANG", "MISSING_TITLE"]),
    ('<html lang=de><title></title><title>x</title><main><h1>h</h1></main>', ["MISSING_TITLE"]),
    ('<html lang=en><title>t</title><a href="#nonexistent">Skip to main</a><nav></nav><main><h1>h</h1></main>',
     ["BROKEN_SKIP_LINK"]),
    ('<html lang=en><title>t</title><a href="/x" aria-label="JUMP over CONTENT">x</a><nav></nav><main><h1>h</h1></main>', []),
    ('<html lang=en><title>t</title><a href="#">Skip to content</a><nav></nav><main><h1>h</h1></main>', []),
    ('<html lang=en><title>t</title><div role=navigation></div><main><h1>h</h1></main>', ["NO_SKIP_LINK"]),
    ('<html lang=en><title>t</title><nav>' + '<a href="/x">x</a>' * 10
     + '<a href="#main">skip</a></nav><main id=main><h1>h</h1></main>', ["NO_SKIP_LINK"]),
    ('<html lang=en><title>t</title><nav>' + '<a href="/x">x</a>' * 9
     + '<a href="#main">skip</a></nav><main id=main><h1>h</h1></main>', []),
]


@pytest.fixture(scope="module")
def reports(spark, pages_of):
    sources = [VALID.format(markup) for markup, _ in PLACED] + [html for html, _ in WHOLE]
    rows = scan_pages(pages_of(*sources)).select("page_id", "issues").collect()
    return {row.page_id: [issue.code for issue in row.issues] for row in rows}


@pytest.mark.parametrize("n", range(len(PLACED)))
def test_markup_in_a_valid_page(reports, n):
    assert reports[n] == PLACED[n][1], PLACED[n][0]


@pytest.mark.parametrize("n", range(len(WHOLE)))
def test_whole_pages(reports, n):
    assert reports[len(PLACED) + n] == WHOLE[n][1], WHOLE[n][0]


def test_messages_and_contexts(pages_of):
    html = VALID.format(
        '<h4>x</h4><p style="color:#777;background:#fff">t</p>' + '<img src="' + "x" * 300 + '">'
    )
    found = {i.code: i for i in scan_issues(pages_of(html)).collect()}
    assert found["HEADING_ORDER"].message == "Heading level jumps from h1 to h4 (may confuse screen readers)."
    assert found["HEADING_ORDER"].context == "sequence: [1, 4]"
    assert found["LOW_CONTRAST"].message.startswith("Low contrast ratio (4.48:1)")
    assert found["IMG_MISSING_ALT"].context == ('<img src="' + "x" * 300)[:200]


def test_wcag_level_raises_the_threshold(pages_of):
    html = VALID.format('<p style="color:#666;background:#fff">t</p>')
    assert scan_issues(pages_of(html)).count() == 0
    issue = scan_issues(pages_of(html), rules=R.default_rules("AAA")).first()
    assert issue.code == "LOW_CONTRAST" and "WCAG AAA requires at least 7.0:1." in issue.message


def test_registry():
    rules = R.default_rules()
    assert len(rules.names()) == 12 and rules.names()[0] == "alt_text" and rules.names()[-1] == "media"
    rules.unregister("media")
    rules.unregister("media")
    rules.register(R.Rule("aria", "replaced", ()))
    assert rules.get("media") is None and rules.get("aria").description == "replaced"
    assert rules.names().index("aria") == 9
    assert R.rule_names(" a, ,b,") == ["a", "b"]
    assert [r.name for r in rules.active(exclude=["alt_text", "unknown"])][0] == "form_labels"


def test_own_rule_and_exclusion(pages_of):
    rules = R.RuleSet([
        R.Rule("marquee", "No marquees", (R.Check("MARQUEE", "filter(dom, e -> e.tag = 'marquee')", "'No marquees.'", "e.tag"),)),
        R.default_rules().get("language"),
    ])
    rows = scan_issues(pages_of("<marquee>x</marquee>"), rules=rules).select("analyzer", "code", "context").collect()
    assert [tuple(r) for r in rows][0] == ("marquee", "MARQUEE", "marquee")
    assert {r.code for r in rows} == {"MARQUEE", "MISSING_LANG"}
    left = scan_issues(pages_of("<marquee>x</marquee>"), rules=rules, exclude=["marquee", "language"])
    assert left.count() == 0


def test_failing_custom_rule_contributes_nothing(pages_of):
    def check(html):
        return [{"code": "C", "message": "m", "context": html[1 // (len(html) - 1) - 1:]}] if html else []

    rows = R.html_rule(pages_of("x", "yy"), "own", check).collect()
    assert [(r.page_id, r.analyzer, r.code) for r in rows] == [(1, "own", "C")]


def test_legacy_rules_differ(pages_of):
    html = VALID.format('<a href="/" aria-label="x"></a><input title="t"><input type=reset><h3>x</h3>')
    rows = scan_issues(pages_of(html), rules=R.legacy_rules()).collect()
    assert [r.code for r in rows] == ["LINK_NO_TEXT", "HEADING_ORDER", "FORM_CONTROL_NO_LABEL", "FORM_CONTROL_NO_LABEL"]
    assert rows[1].message == "Heading level jumps (may confuse screen readers)."


def test_null_markup_is_an_empty_page(spark):
    pages = spark.createDataFrame([(1, "u", None)], "page_id long, url string, html string")
    row = scan_pages(pages).first()
    assert row.total == 3 and row.parse_error is None


def test_many_nested_links_and_images(pages_of):
    """Containment stays exact when one page holds thousands of containers."""
    body = "".join(f'<a href="/{i}"><img {"alt=x" if i % 2 else ""}></a>' for i in range(3000))
    codes = Counter(r.code for r in scan_issues(pages_of(VALID.format(body))).select("code").collect())
    assert codes == {"IMG_MISSING_ALT": 1500, "LINK_IMG_MISSING_ALT": 1500}


def test_elements_table(pages_of):
    table = elements(pages_of("<p class=c>x<img alt=y></p>"))
    row = table.where("tag = 'img'").first()
    assert (row.node_id, row.parent_id, row.attrs, row.depth) == (3, 2, {"alt": "y"}, 3)
    assert table.where(F.col("tag") == "p").first().subtree_end == 3


def test_checking_needs_no_shuffle_and_one_python_step(pages_of, spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = scan_pages(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    # The only exchange widens an input of fewer splits than cores, before anything is parsed.
    assert plan.count("Exchange") == plan.count("Exchange RoundRobinPartitioning")
    wide = pages.repartition(64)
    plan = with_dom(wide)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the caller's own


def test_lost_markup_and_failing_rules_are_visible(spark, pages_of):
    pages = pages_of("<p>a</p><img src='x", "<p>whole</p>")
    errors = {r.page_id: r.parse_error for r in with_dom(pages).select("page_id", "parse_error").collect()}
    assert errors == {0: "the page ends inside a tag; its last 11 characters are left out", 1: None}

    def analyze(html):
        if "whole" in html:
            raise ValueError("no")
        return [{"code": "X", "message": "m", "context": None}]

    got = R.html_rule(pages, "own", analyze, errors=True).orderBy("page_id").collect()
    assert [(r.code, r.error) for r in got] == [("X", None), (None, "ValueError: no")]
    assert [r.code for r in R.html_rule(pages, "own", analyze).collect()] == ["X"]

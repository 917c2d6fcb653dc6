import colorsys
import random
import re
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from sightline.functions import color as C, severity as S, text as X, urls as U


def evaluate(spark, values, expression):
    rows = [(i, v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "i int, x string").selectExpr("i", f"{expression} AS y")
    return [r.y for r in frame.orderBy("i").collect()]


def test_parse_color(spark):
    cases = {
        "#777777": "#777777", " #FFF": "#ffffff", "Grey ": "#808080", "rgb(1, 2,3)": "#010203",
        "rgba(100%,0%,50%,.4)": "#640032", "hsl(120,100%,25%)": "#007f00", "hsl(0, 0%, 60%)": "#999999",
        "#12345678": "#123456", "#1234": "#1234", "#12345z": "#12345", "var(--x)": None, "": None, "#gg": None,
        "rgb(1,2)": None, "rgb(a,2,3)": None, "rgb(1.5,2,3)": None, "hsl(x,1%,1%)": None, "rebeccapurple": None,
        "RGB(1,2,3)": "#010203", "rgb(300,2,3)": "#12c0203",
    }
    assert evaluate(spark, cases, C.parse_color("x")) == list(cases.values())


def test_parse_fix_color(spark):
    cases = {"#FFF": "#ffffff", "white": None, "hsl(0,0%,0%)": None, "RGB(1,2,3)": None, "rgb(1,2,3)": "#010203"}
    assert evaluate(spark, cases, C.parse_fix_color("x")) == list(cases.values())
    bad = {"rgb(1,2)": True, "rgb(x,1,2)": True, "rgb(1,2,3)": False, "#fff": False, "red": False}
    assert evaluate(spark, bad, C.malformed_fix_color("x")) == list(bad.values())


def test_hsl_agrees_with_the_standard_conversion(spark):
    random.seed(1)
    triples = [(random.randrange(0, 361), random.randrange(0, 101), random.randrange(0, 101)) for _ in range(300)]
    got = evaluate(spark, [f"hsl({h}, {s}%, {l}%)" for h, s, l in triples], C.parse_color("x"))
    for (h, s, l), color in zip(triples, got):
        want = colorsys.hls_to_rgb(h / 360, l / 100, s / 100)
        have = [int(color[i:i + 2], 16) for i in (1, 3, 5)]
        assert all(abs(a * 255 - b) < 1.001 for a, b in zip(want, have)), (h, s, l, color)


def test_contrast(spark):
    def luminance(color):
        channels = [int(color[i:i + 2], 16) / 255 for i in (1, 3, 5)]
        lin = [c / 12.92 if c <= 0.03928 else ((c + 0.055) / 1.055) ** 2.4 for c in channels]
        return sum(a * b for a, b in zip((0.2126, 0.7152, 0.0722), lin))

    random.seed(2)
    colors = ["#%06x" % random.randrange(1 << 24) for _ in range(200)] + ["#000000", "#ffffff"]
    got = evaluate(spark, colors, C.contrast_ratio("x", "'#ffffff'"))
    for color, ratio in zip(colors, got):
        assert abs(ratio - 1.05 / (luminance(color) + 0.05)) < 1e-9
    chosen = evaluate(spark, colors, C.recommend_foreground("x"))
    for color, foreground in zip(colors, chosen):
        assert foreground == ("#000000" if (luminance(color) + 0.05) / 0.05 >= 4.5 else "#ffffff")
    assert evaluate(spark, ["#1234"], C.contrast_ratio("x", "'#ffffff'")) == [None]


def test_style_declarations(spark):
    style = "color:red ; Background : url(a:b);x;color: blue"
    assert evaluate(spark, [style], C.last_value(C.style_declarations("x"), "color")) == ["blue"]
    assert evaluate(spark, [style], C.last_value(C.style_declarations("x"), "background")) == ["url(a:b)"]
    assert evaluate(spark, [style], C.last_value(C.style_declarations("x"), "font")) == [None]


BASES = ["http://h.test/a/b/c?x=1#f", "https://h.test:8080", "http://h/p/", "http://h.test/a", "http://h/a//b/"]
HREFS = [
    "", "/x", "x", "../x", "../../../x", "./x/./y", "?q=2", "#top", "//o.test/z", "http://o.test/q/../r?z#k",
    "mailto:a@b", "x/", "..", ".", "x?y#z", "/a/../b/./c/..", "javascript:void(0)", "a b|c", "../", "/", " /sp",
    "HTTP://h/x", "x\ny", "tel:1", "a:b", "./", "?", "x;p=1/../y",
]


def test_resolve_url_agrees_with_urljoin(spark):
    pairs = [(b, h) for b in BASES for h in HREFS]
    frame = spark.createDataFrame([(i, b, h) for i, (b, h) in enumerate(pairs)], "i int, b string, h string")
    got = frame.orderBy("i").selectExpr(f"{U.resolve_url('b', 'h')} AS u", f"{U.without_fragment(U.resolve_url('b', 'h'))} AS v").collect()
    for (base, href), row in zip(pairs, got):
        want = urljoin(base, href)
        if href not in ("?",):
            assert row.u == want, (base, href)
        assert row.v == row.u.split("#")[0]


def test_url_parts_agree_with_urlparse(spark):
    urls = [urljoin(b, h) for b in BASES for h in HREFS] + ["http://u:p@h:1/x", "http://h?q", "nothing", "//h/x"]
    assert evaluate(spark, urls, U.netloc("x")) == [urlparse(u).netloc for u in urls]
    got = evaluate(spark, urls, U.path("x"))
    for url, path in zip(urls, got):
        if ";" not in url:
            assert path == (urlparse(url).path or "/"), url
    valid = {"http://a": True, "HTTPS://a/b": True, "ftp://a": False, "http://": False, "a.test": False, "http:///x": False}
    assert evaluate(spark, valid, U.valid_scan_url("x")) == list(valid.values())


def test_text(spark):
    assert evaluate(spark, ["  a \n", " "], X.strip("x")) == ["a", ""]
    assert evaluate(spark, [None, "", " \t", " x "], X.blank("x")) == [True, True, True, False]
    assert evaluate(spark, ["""<a href="x">&'</a>"""], X.html_escape("x")) == [
        "&lt;a href=&quot;x&quot;&gt;&amp;&#x27;&lt;/a&gt;"]
    url = "https://example.com/a_b?c=" + "d" * 60
    assert evaluate(spark, [url], X.anchor_id("x")) == [re.sub("[^a-zA-Z0-9]", "-", url)[:50]]
    assert evaluate(spark, ["abc", "abcd"], X.shortened("x", 3)) == ["abc", "abc..."]
    assert evaluate(spark, ["a/b.png", "b.png", "a/"], X.file_name("x")) == ["b.png", "b.png", ""]
    assert evaluate(spark, ["http://a/b/c"], X.page_file_name("x")) == ["http_a_b_c.html"]


def test_severity(spark):
    codes = ["IMG_MISSING_ALT", "LOW_CONTRAST", "HEADING_ORDER", "MISSING_H1", "NO_SUCH_CODE", None]
    assert evaluate(spark, codes, S.severity_of("x")) == ["critical", "major", "minor", "minor", "minor", "minor"]
    assert evaluate(spark, codes, S.wcag_of("x")) == ["1.1.1", "1.4.3", "1.3.1", None, None, None]
    assert evaluate(spark, codes, S.wcag_name_of("x"))[1] == "Contrast (Minimum)"
    assert evaluate(spark, codes, S.impact_of("x"))[0] == "Screen reader users cannot understand image content"
    levels = ["critical", "major", "minor", "odd", None]
    assert evaluate(spark, levels, S.severity_rank("x")) == [0, 1, 2, 2, 2]
    assert evaluate(spark, levels, S.severity_color("x")) == ["red", "yellow", "blue", "white", "white"]
    assert evaluate(spark, levels, S.severity_emoji("x")) == ["🔴", "🟡", "🔵", "⚪", "⚪"]

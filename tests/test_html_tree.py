import tracemalloc

import pyarrow as pa
from hypothesis import given, settings, strategies as st

from sightline.operators import dom
from sightline.operators.html_tree import Page


def outline(html):
    page = Page(html)
    return [(page.tag[i], page.parent[i]) for i in range(len(page.tag))]


def test_root_and_body_are_implied():
    assert outline("x") == [("html", -1), ("body", 0), ("p", 1)]
    assert outline("<title>t</title><div>d") == [("html", -1), ("head", 0), ("title", 1), ("body", 0), ("div", 3)]
    assert outline("") == []


def test_end_tags_are_implied():
    page = Page("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><th>3</table><p>x<p>y<select><option>1<option>2</select>")
    parent = {i: page.tag[p] for i, p in enumerate(page.parent) if p >= 0}
    kinds = [(page.tag[i], parent[i]) for i in parent]
    assert kinds.count(("li", "ul")) == 2
    assert kinds.count(("tr", "table")) == 2
    assert kinds.count(("td", "tr")) == 2 and kinds.count(("th", "tr")) == 1
    assert kinds.count(("p", "body")) == 2
    assert kinds.count(("option", "select")) == 2


def test_subtree_end():
    page = Page("<a href=x><b><img></b></a><i>z</i>")
    assert page.end[page.tag.index("a")] == page.end[page.tag.index("b")] == page.tag.index("img")
    assert page.end[page.tag.index("i")] == page.tag.index("i")


def test_stray_and_crossing_end_tags():
    page = Page("<a><div></a><img></div></span>")
    assert page.parent[page.tag.index("img")] == page.tag.index("div")
    page = Page("<a><b></a><img>")
    assert page.tag[page.parent[page.tag.index("img")]] == "body"


def test_text_is_joined_without_separator_and_skips_scripts():
    page = Page("<a>Skip <b>to</b> main<script>var x='no'</script><!-- c --></a>")
    assert page.text(page.tag.index("a")) == "Skiptomain"
    assert Page("<button>&nbsp;  </button>").text(2) == ""


def test_raw_text_hides_markup():
    page = Page("<script>var t='</p><img>';</script><title>a <b>x</title><textarea><input></textarea>")
    assert "img" not in page.tag and "b" not in page.tag and "input" not in page.tag


def test_attributes():
    page = Page("""<input DISABLED Value='a"b' data-x=1/2/ value=second title="&lt;&amp;">""")
    assert page.attrs[-1] == {"disabled": "", "value": 'a"b', "data-x": "1/2/", "title": "<&"}
    assert page.markup(len(page.tag) - 1, 200) == (
        """<input disabled="" value='a"b' data-x="1/2/" title="&lt;&amp;"/>"""
    )


def test_quotes_only_count_after_an_equals_sign():
    page = Page("""<a title=it's href="x>y">t</a><img alt="unclosed><p>z""")
    assert page.attrs[page.tag.index("a")] == {"title": "it's", "href": "x>y"}


def test_self_closing_elements_are_empty():
    page = Page('<a href="x"/>text<div/>')
    assert not page.has_text(page.tag.index("a"))


def test_pieces_rebuild_the_page():
    page = Page("<!DOCTYPE html><!-- c --><html><body><p>a &lt; b<br>c<img src=x></body></html> tail")
    text = page.prolog() + "".join(lead + tail for lead, tail in map(page.pieces, range(len(page.tag))))
    assert text == page.canonical
    assert text.startswith("<!DOCTYPE html>\n<!-- c --><html>")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(
    ["<p>", "</p>", "<a href=x>", "</a>", "<table>", "<tr>", "<td>", "</table>", "<div>", "</div>", "<li>", "x", " ",
     "<img>", "<!--", "-->", "<script>", "</script>", "<b", "\"", "'", ">", "<title>", "</title>", "<body>", "</body>",
     "<html lang=en>", "<head>", "</head>", "&amp;", "<button/>", "<label>", "</label>"]), max_size=40))
def test_any_input_gives_a_well_formed_tree(parts):
    page = Page("".join(parts))
    for i, (parent, end) in enumerate(zip(page.parent, page.end)):
        assert parent < i <= end < len(page.tag)
        if parent >= 0:
            assert end <= page.end[parent] and page.depth[i] == page.depth[parent] + 1
    # Reading what was written changes nothing any more.
    again = Page(page.canonical)
    assert again.tag.count("img") == page.tag.count("img")


def test_large_hostile_inputs_stay_linear():
    for text in ("<a b='" * 50_000, "<" * 100_000, "</x>" * 50_000, "<div>" * 20_000, "<!--" * 50_000):
        Page(text)


def test_a_task_holds_few_elements_at_a_time():
    html = "<html lang=en><body>" + "<p class=a>word</p>" * 3000
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(100)), "html": [html] * 100})
    tracemalloc.start()
    pages = [part.num_rows for part in dom.parsed_batches(iter([batch]), ["page_id"], True, True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(pages) == 100 and max(pages) < 20 and peak < 60_000_000

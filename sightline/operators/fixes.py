"""Rewriting pages: alternative text for images, readable colours for inline styles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sightline import vocab
from sightline.functions.color import (
    contrast_ratio, last_value, malformed_fix_color, parse_fix_color, recommend_foreground, style_declarations,
)
from sightline.functions.text import blank, file_name, let, lit, page_file_name, strip, words
from sightline.operators.dom import with_dom
from sightline.operators.html_tree import TOKEN_LISTS, VOID
from sightline.operators.nodes import attr

NEEDS_ALT = f"e.tag = 'img' AND {blank(attr('alt'))}"
SRC = f"coalesce({attr('src')}, '')"
ID = f"coalesce({attr('id')}, '')"
SUGGESTION = (
    f"coalesce(nullif(alt_map[{SRC}], ''), nullif(alt_map[{ID}], ''), nullif({file_name(SRC)}, ''), 'image')"
)
COLORS = ("color", "background-color", "background")


def _start_tag(tag: str, attrs: str) -> str:
    """The start tag of an element, written the way the parsed page is."""
    value = (
        f"CASE WHEN a.key IN ({words(sorted(TOKEN_LISTS))}) "
        f"THEN {strip(f'regexp_replace(a.value, {lit(r"(?U)\s+")}, {lit(" ")})')} ELSE a.value END"
    )
    escaped = f"replace(replace(replace({value}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    quoted = let("v", escaped, (
        "CASE WHEN NOT contains(v, '\"') THEN concat('\"', v, '\"') "
        "WHEN NOT contains(v, '\\'') THEN concat('\\'', v, '\\'') "
        "ELSE concat('\"', replace(v, '\"', '&quot;'), '\"') END"
    ))
    listed = f"array_join(transform(map_entries({attrs}), a -> concat(' ', a.key, '=', {quoted})), '')"
    return f"concat('<', {tag}, {listed}, CASE WHEN {tag} IN ({words(sorted(VOID))}) THEN '/>' ELSE '>' END)"


def _with_attr(attrs: str, name: str, value: str) -> str:
    """The attributes with one set; a new one comes last."""
    return (
        f"CASE WHEN map_contains_key({attrs}, {lit(name)}) "
        f"THEN transform_values({attrs}, (k, v) -> CASE WHEN k = {lit(name)} THEN {value} ELSE v END) "
        f"ELSE map_concat({attrs}, map({lit(name)}, {value})) END"
    )


def _style_fix() -> str:
    """Replacement style and colour of an element whose inline colours are hard to read; null if none."""
    decls = f"{style_declarations(attr('style'))}"
    pair = let("decls", decls, (
        f"struct({parse_fix_color(last_value('decls', 'color'))} AS fg, "
        f"{parse_fix_color(last_value('decls', 'background-color', 'background'))} AS bg)"
    ))
    parts = f"filter(split({attr('style')}, ';'), part -> NOT {blank('part')})"
    is_color = f"contains(part, ':') AND lower({strip("substring_index(part, ':', 1)")}) = 'color'"
    first = f"array_position(transform(parts, part -> {is_color}), true)"
    new_style = let("parts", parts, let("at", first, (
        "array_join(transform(parts, (part, i) -> CASE WHEN i + 1 = at THEN concat('color: ', fix_fg) ELSE part END), '; ')"
    )))
    readable = let("fix_fg", recommend_foreground("pair.bg"), f"struct(fix_fg AS color, {new_style} AS style)")
    ratio = contrast_ratio("pair.fg", "pair.bg")
    return (
        f"CASE WHEN {attr('style')} RLIKE '(?is)color.*background|background.*color' THEN "
        + let("pair", pair, f"CASE WHEN {ratio} < {vocab.CONTRAST_THRESHOLDS['AA']}D THEN {readable} END")
        + " END"
    )


MALFORMED = (
    f"exists(filter(dom, e -> {attr('style')} IS NOT NULL), e -> exists({style_declarations(attr('style'))}, "
    f"d -> d.name IN ({words(COLORS)}) AND {malformed_fix_color('d.value')}))"
)
FIX_ERROR = "CASE WHEN malformed THEN 'rgb() colour without three whole numbers' END"


def _context(lead: str) -> str:
    """Outer markup of element ``e`` with its own start tag ``lead``, after the image fixes."""
    limit = vocab.CONTEXT_CHARS
    inner = f"slice(parts, e.node_id + 2, least(e.subtree_end - e.node_id, {limit}))"
    grown = f"coalesce(aggregate(transform({inner}, x -> x.grown), 0, (s, x) -> s + x), 0)"
    joined = f"concat({lead}, e.tail, array_join(transform({inner}, x -> concat(x.alt_lead, x.tail)), ''))"
    length = f"e.outer_len - length(e.lead) + length({lead}) + {grown}"
    return f"substring({joined}, 1, least({limit}, {length}))"


def _alt_maps(pages: DataFrame, alt_lookup: DataFrame) -> DataFrame:
    """Pages with the look-up entries their images ask for (``alt_map``).

    Only image keys are joined, so neither markup nor look-up has to fit anywhere; a key many images
    share is split by adaptive skew handling.
    """
    images = with_dom(pages.select("page_id", "html"), markup=False).selectExpr("page_id", "explode(dom) AS e")
    keys = images.where(NEEDS_ALT).selectExpr("page_id", f"explode(array({SRC}, {ID})) AS key").where("key <> ''")
    keys = keys.distinct()
    entries = alt_lookup.groupBy("key").agg(F.max("alt").alias("alt"))
    maps = keys.join(entries, "key").groupBy("page_id").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "alt"))).alias("alt_map")
    )
    return pages.join(maps, "page_id", "left").withColumn(
        "alt_map", F.coalesce("alt_map", F.expr("cast(map() AS MAP<STRING, STRING>)"))
    )


def apply_fixes(pages: DataFrame, alt_lookup: dict[str, str] | DataFrame | None = None, *, edits: bool = False) -> DataFrame:
    """Pages with ``fixed_html``, the ``applied`` fixes in order, and ``fix_error``.

    Problems are found again on the page itself. ``alt_lookup`` gives alternative texts by image
    ``src`` or ``id``: a small dictionary, or a table ``(key, alt)`` of any size. A page with an
    unreadable rgb() colour is left alone and gets a ``fix_error``. Apart from joining such a table
    everything happens in the row of the page.

    ``edits=True`` adds the same rewriting as a script: ``parsed_html``, the page as the parser writes it, and ``edits``, a list of
    ``at`` (place in ``parsed_html``), ``old`` and ``new`` text in order of place. Every edit is one whole start tag, with both fixes of it
    in one, so edits never overlap. ``spliced`` applies a script or takes it back.
    """
    if isinstance(alt_lookup, DataFrame):
        mapped = _alt_maps(pages, alt_lookup)
    else:
        pairs = ", ".join(f"{lit(k)}, {lit(v)}" for k, v in (alt_lookup or {}).items())
        mapped = pages.withColumn("alt_map", F.expr(f"cast(map({pairs}) AS MAP<STRING, STRING>)"))
    keys = [name for name in pages.columns if name != "html"]
    parsed = with_dom(mapped, markup=False, pieces=True)
    decided = parsed.selectExpr(
        *keys, "prolog", f"{MALFORMED} AS malformed",
        "transform(dom, e -> struct(e.node_id, e.subtree_end, e.outer_len, e.tag, e.attrs, e.lead, e.tail, e.at, "
        f"CASE WHEN {NEEDS_ALT} THEN {SUGGESTION} END AS alt, {_style_fix()} AS style)) AS parts",
    )
    named = decided.selectExpr(
        *keys, "prolog", "malformed",
        "transform(transform(parts, e -> struct(e.node_id, e.subtree_end, e.outer_len, e.tag, "
        f"CASE WHEN e.alt IS NULL THEN e.attrs ELSE {_with_attr('e.attrs', 'alt', 'e.alt')} END AS attrs, "
        "e.lead, e.tail, e.at, e.alt, e.style)), e -> struct(e.node_id, e.subtree_end, e.outer_len, e.tag, e.attrs, e.lead, "
        f"e.tail, e.at, e.alt, e.style, CASE WHEN e.alt IS NULL THEN e.lead ELSE {_start_tag('e.tag', 'e.attrs')} END "
        "AS alt_lead)) AS parts",
    )
    styled = named.selectExpr(
        *keys, "prolog", "malformed",
        "transform(parts, e -> struct(e.node_id, e.subtree_end, e.outer_len, e.lead, e.tail, e.at, e.alt, e.style, e.alt_lead, "
        "length(e.alt_lead) - length(e.lead) AS grown, CASE WHEN e.style IS NULL THEN e.alt_lead ELSE "
        f"{_start_tag('e.tag', _with_attr('e.attrs', 'style', 'e.style.style'))} END AS new_lead)) AS parts",
    )
    alts = (
        "transform(filter(parts, e -> e.alt IS NOT NULL), e -> struct('IMG_MISSING_ALT' AS code, "
        f"concat('set alt=\\'', e.alt, '\\'') AS fix, {_context('e.alt_lead')} AS context))"
    )
    styles = (
        "transform(filter(parts, e -> e.style IS NOT NULL), e -> struct('LOW_CONTRAST' AS code, "
        f"concat('set color=', e.style.color) AS fix, {_context('e.new_lead')} AS context))"
    )
    html = "concat(prolog, array_join(transform(parts, e -> concat(e.new_lead, e.tail)), ''))"
    script = [
        "concat(prolog, array_join(transform(parts, e -> concat(e.lead, e.tail)), '')) AS parsed_html",
        "CASE WHEN malformed THEN array() ELSE transform(filter(parts, e -> e.new_lead <> e.lead), "
        "e -> struct(e.at, e.lead AS old, e.new_lead AS new)) END AS edits",
    ]
    return styled.selectExpr(
        *keys,
        f"CASE WHEN NOT malformed THEN {html} END AS fixed_html",
        f"CASE WHEN malformed THEN array() ELSE concat({alts}, {styles}) END AS applied",
        f"{FIX_ERROR} AS fix_error",
        *(script if edits else []),
    )


def _splice(markup: str, edits, undo: bool) -> str:
    out, done, shift = [], 0, 0
    for edit in edits:
        old, new = (edit["new"], edit["old"]) if undo else (edit["old"], edit["new"])
        at = edit["at"] + shift if undo else edit["at"]
        if at < done or markup[at : at + len(old)] != old:
            raise ValueError(f"the edit at {edit['at']} does not fit the markup")
        out += [markup[done:at], new]
        done = at + len(old)
        shift += len(edit["new"]) - len(edit["old"])
    return "".join([*out, markup[done:]])


def spliced(markup: str, edits: str, *, undo: bool = False) -> Column:
    """The markup column with its edits applied, or taken back; null if either is null. An edit whose old text is not found at
    its place, or that overlaps the one before, is an error."""

    @F.pandas_udf("string")
    def splice(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or e is None else _splice(t, e, undo) for t, e in zip(texts, lists)], dtype=object)

    return splice(markup, edits)


def edit_rows(fixed: DataFrame) -> DataFrame:
    """One row per edit: the keys of the page, ``pos``, ``at``, ``old`` and ``new``, narrow enough to store instead of rewritten pages."""
    keys = [name for name in fixed.columns if name not in ("fixed_html", "applied", "fix_error", "parsed_html", "edits")]
    rows = fixed.select(*keys, F.posexplode_outer("edits").alias("pos", "e")).where("e IS NOT NULL")
    return rows.select(*keys, "pos", "e.at", "e.old", "e.new")


def fix_rows(fixed: DataFrame) -> DataFrame:
    """One row per applied fix, in order."""
    keys = [name for name in fixed.columns if name not in ("fixed_html", "applied", "fix_error", "parsed_html", "edits")]
    rows = fixed.select(*keys, F.posexplode_outer("applied").alias("pos", "f")).where("f IS NOT NULL")
    return rows.select(*keys, "pos", "f.code", "f.fix", "f.context")


def fix_summary(fixed: DataFrame, *keys: str) -> DataFrame:
    """Fixes per code."""
    return fix_rows(fixed).groupBy(*keys, "code").agg(F.count("*").alias("n"))


def fix_report(fixed: DataFrame) -> DataFrame:
    """Per page: how many fixes, the first ones as lines, and the start of the new markup."""
    line = "concat('   - ', f.code, ': ', f.fix)"
    return fixed.selectExpr(
        "page_id", "url", "size(applied) AS n",
        f"transform(slice(applied, 1, {vocab.CONSOLE_FIXES}), f -> {line}) AS lines",
        f"substring(fixed_html, 1, {vocab.SNIPPET_CHARS}) AS fixed_html_snippet", "fix_error",
    )


def write_fixed_html(fixed: DataFrame, path: str, *, file_per_page: bool = False) -> None:
    """Write the rewritten pages under their file names.

    By default as a table (``fname, html``); ``file_per_page`` makes a folder with one text file for
    every page, for scans small enough for that.
    """
    named = fixed.where("fixed_html IS NOT NULL").selectExpr(f"{page_file_name('url')} AS fname", "fixed_html AS html")
    if file_per_page:
        named.write.partitionBy("fname").text(path)
    else:
        named.write.parquet(path)


def site_prompts(scanned: DataFrame) -> DataFrame:
    """A request text per site, about its list of pages (by ``page_id``); needs ``site``.

    An address takes at least one character and a line break, so no more rows of a site than the text has room for can
    matter; the limit is applied before the shuffle, and a site of any size is one small list.
    """
    room = vocab.PROMPT_HTML_CHARS
    first = Window.partitionBy("site").orderBy("page_id", "url")
    listed = scanned.where("url IS NOT NULL AND url <> ''").select("site", "page_id", "url")
    kept = listed.withColumn("place", F.row_number().over(first)).where(F.col("place") <= room // 2)
    pages = kept.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("place", "url"))).alias("pages"))
    return pages.selectExpr(
        "site",
        f"concat({lit(vocab.PROMPT_INTRO)}, '\\n\\nFound issues: []\\n\\nHTML snippet (truncated):\\n', "
        f"substring(array_join(pages.url, '\\n'), 1, {room})) AS prompt",
    )


def suggestion_prompts(scanned: DataFrame) -> DataFrame:
    """A request text per page for a model that suggests fixes; needs ``html`` and ``issues``."""
    shown = "to_json(transform(issues, i -> struct(i.code, i.message, i.context, i.analyzer)))"
    return scanned.selectExpr(
        "page_id", "url",
        f"concat({lit(vocab.PROMPT_INTRO)}, '\\n\\nFound issues: ', {shown}, '\\n\\nHTML snippet (truncated):\\n', "
        f"substring(html, 1, {vocab.PROMPT_HTML_CHARS})) AS prompt",
    )

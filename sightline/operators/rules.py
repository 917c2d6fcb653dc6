"""The accessibility rules: what each one looks for, as expressions over a page's element list."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sightline import vocab
from sightline.functions.color import contrast_ratio, last_value, parse_color, style_declarations
from sightline.functions.text import blank, empty, let, lit, strip, words
from sightline.operators.nodes import (
    FOCUSABLE, HEADINGS, IS_MAIN, IS_NAVIGATION, MARKED, NAMELESS,
    all_blank, attr, before, by_attr, by_tag, exists, first_in, following, holds, holds_two, ids, inside, select,
)

ISSUE_TYPE = (
    "array<struct<analyzer_ord:int,loop_ord:int,node_id:int,check_ord:int,"
    "analyzer:string,code:string,message:string,context:string>>"
)
ISSUE_ORDER = ("analyzer_ord", "loop_ord", "node_id", "check_ord")


@dataclass(frozen=True)
class Check:
    """One kind of issue a rule reports.

    ``found`` is an expression over ``dom`` for the list of findings, structs with at least a
    ``node_id``; message and context are expressions over one finding ``e``. Issues come out by ``loop``, then
    in document order, then by ``step``.
    """

    code: str
    found: str
    message: str
    context: str = "e.markup"
    loop: int = 0
    step: int = 0


@dataclass(frozen=True)
class Rule:
    """A named set of checks."""

    name: str
    description: str
    checks: tuple[Check, ...]


class RuleSet:
    """An ordered collection of rules, by name."""

    def __init__(self, rules: Iterable[Rule] = ()):
        self._rules = {rule.name: rule for rule in rules}

    def register(self, rule: Rule) -> None:
        self._rules[rule.name] = rule

    def unregister(self, name: str) -> None:
        self._rules.pop(name, None)

    def get(self, name: str) -> Rule | None:
        return self._rules.get(name)

    def names(self) -> list[str]:
        return list(self._rules)

    def active(self, exclude: Iterable[str] = ()) -> list[Rule]:
        skipped = set(exclude)
        return [rule for name, rule in self._rules.items() if name not in skipped]

    def table(self, spark: SparkSession) -> DataFrame:
        """Name and description of every rule."""
        rows = [(rule.name, rule.description) for rule in self._rules.values()]
        return spark.createDataFrame(rows, "name string, description string")


def rule_names(listing: str) -> list[str]:
    """Names in a comma-separated list; blanks are dropped."""
    return [name for name in map(str.strip, listing.split(",")) if name]


LAYOUT_TABLE = f"coalesce(lower({attr('role')}) IN ({words(vocab.LAYOUT_TABLE_ROLES)}), false)"

LABELS = by_tag("label")
# Lists several checks read, computed once per page.
SHARED = {
    "images_from": following(by_tag("img")),
    "label_targets": f"transform({select(f"e.tag = 'label' AND {attr('for')} IS NOT NULL")}, e -> {attr('for')})",
    "labels_begun": before(ids(LABELS)),
    "labels_ended": before(f"array_sort(transform({LABELS}, e -> e.subtree_end))"),
    "n_labels": f"size({LABELS})",
    "headings": (
        f"transform({by_tag(*HEADINGS)}, "
        "e -> struct(e.node_id AS node_id, cast(substring(e.tag, 2, 1) AS INT) AS level))"
    ),
    "h1s": by_tag("h1"),
    "headers_from": following(by_tag("th")),
    "data_tables": let("rows_from", following(by_tag("tr")), select(f"e.tag = 'table' AND NOT {LAYOUT_TABLE} AND {holds_two('rows_from')}")),
    "body": f"get({by_tag('body')}, 0)",
}


def printf(message: str, *args: str) -> str:
    return f"format_string({', '.join([lit(message), *args])})"


def on_page(condition: str, facts: str = "") -> str:
    """One finding about the page as a whole, if ``condition`` holds."""
    extra = f", {facts}" if facts else ""
    return f"filter(array(struct(0 AS node_id{extra})), p -> {condition})"


# -- alternative text ---------------------------------------------------------------------

IMAGES_WITHOUT_ALT = select(f"e.tag = 'img' AND {blank(attr('alt'))}")
TEXTLESS_LINK = "e.tag = 'a' AND NOT e.has_text"
FIRST_IMAGE_NAMED = f"NOT {blank(f"get(dom, {first_in('images_from')}).attrs['alt']")}"
LINKED_UNNAMED_IMAGES = select(f"{TEXTLESS_LINK} AND {holds('images_from')} AND NOT ({FIRST_IMAGE_NAMED})")

ALT_TEXT = (
    Check("IMG_MISSING_ALT", IMAGES_WITHOUT_ALT, lit(vocab.MSG_IMG_MISSING_ALT)),
    Check("LINK_IMG_MISSING_ALT", LINKED_UNNAMED_IMAGES, lit(vocab.MSG_LINK_IMG_MISSING_ALT), loop=1),
)

# -- forms ----------------------------------------------------------------------------------


def unlabelled(skipped_types: Iterable[str], naming: Iterable[str]) -> str:
    named = " OR ".join(f"NOT {empty(attr(name))}" for name in naming)
    targeted = f"coalesce({attr('id')} <> '' AND array_contains(label_targets, {attr('id')}), false)"
    return select(
        "e.tag IN ('input', 'textarea', 'select') "
        f"AND NOT coalesce(lower({attr('type')}), '') IN ({words(skipped_types)}) "
        f"AND NOT ({named}) AND NOT {targeted} AND NOT {inside('labels_begun', 'labels_ended', 'n_labels')}"
    )


FORM_LABELS = (
    Check("FORM_CONTROL_NO_LABEL",
          unlabelled(vocab.UNLABELLED_INPUT_TYPES, ("aria-label", "aria-labelledby", "title")),
          lit(vocab.MSG_FORM_CONTROL_NO_LABEL)),
)

# -- headings -------------------------------------------------------------------------------

HEADING_JUMP = (
    "slice(filter(transform(headings, (h, i) -> struct(h.node_id AS node_id, h.level AS level, "
    "get(headings, i - 1).level AS previous)), h -> h.level - h.previous > 1), 1, 1)"
)
HEADING_LEVELS = (
    "concat('sequence: [', array_join(transform("
    f"slice(headings, 1, {vocab.HEADING_SEQUENCE_LENGTH}), h -> cast(h.level AS STRING)), ', '), ']')"
)

HEADING_ORDER = (
    Check("HEADING_ORDER", HEADING_JUMP, printf(vocab.MSG_HEADING_ORDER, "e.previous", "e.level"), HEADING_LEVELS),
)

# -- contrast -------------------------------------------------------------------------------

STYLED = select(f"{attr('style')} RLIKE '(?is)color.*background|background.*color'")


def style_contrast(read: Callable[[str], str] = parse_color) -> str:
    """Elements whose inline style sets both colours: ``array<struct<node_id, markup, fg, bg, ratio>>``."""
    declared = (
        f"transform({STYLED}, e -> struct(e.node_id AS node_id, e.markup AS markup, "
        f"{style_declarations(attr('style'))} AS style))"
    )
    foreground = read(last_value("e.style", "color"))
    background = read(last_value("e.style", "background-color", "background"))
    colored = (
        f"transform({declared}, e -> struct(e.node_id AS node_id, e.markup AS markup, "
        f"{foreground} AS fg, {background} AS bg))"
    )
    return (
        f"transform(filter({colored}, e -> e.fg IS NOT NULL AND e.bg IS NOT NULL), "
        "e -> struct(e.node_id AS node_id, e.markup AS markup, e.fg AS fg, e.bg AS bg, "
        f"{contrast_ratio('e.fg', 'e.bg')} AS ratio))"
    )


def contrast(level: str = "AA") -> tuple[Check, ...]:
    threshold = vocab.CONTRAST_THRESHOLDS[level]
    message = vocab.MSG_LOW_CONTRAST.format(level=level, threshold=threshold)
    low = f"filter({style_contrast()}, e -> e.ratio < {threshold}D)"
    return (Check("LOW_CONTRAST", low, printf(message, "e.ratio")),)


# -- links, language ------------------------------------------------------------------------

LINK_TEXT = (
    Check("LINK_NO_TEXT",
          select(f"e.tag = 'a' AND {NAMELESS} AND NOT {holds('images_from')}"),
          lit(vocab.MSG_LINK_NO_TEXT)),
)

ROOT_LANGUAGE = (
    "transform(filter(slice(dom, 1, 1), e -> e.tag = 'html'), e -> struct(e.node_id AS node_id, "
    f"coalesce({strip(attr('lang'))}, '') AS lang, substring(e.markup, 1, {vocab.LANG_CONTEXT_CHARS}) AS markup))"
)
KNOWN_LANGUAGE = f"lower(substring_index(e.lang, '-', 1)) IN ({words(vocab.LANGUAGE_CODES)})"

LANGUAGE = (
    Check("MISSING_LANG", f"filter({ROOT_LANGUAGE}, e -> e.lang = '')", lit(vocab.MSG_MISSING_LANG)),
    Check("INVALID_LANG", f"filter({ROOT_LANGUAGE}, e -> e.lang <> '' AND NOT {KNOWN_LANGUAGE})",
          printf(vocab.MSG_INVALID_LANG, "e.lang")),
)

# -- buttons --------------------------------------------------------------------------------


def unnamed_buttons(where: str) -> str:
    return select(f"{where} AND {NAMELESS} AND NOT ({holds('images_from')} AND {FIRST_IMAGE_NAMED})")


UNNAMED_INPUTS = select(
    f"e.tag = 'input' AND {attr('type')} IN ({words(vocab.BUTTON_INPUT_TYPES)}) "
    f"AND {all_blank('value', 'aria-label', 'aria-labelledby', 'title')} "
    f"AND ({attr('type')} <> 'submit' OR coalesce({attr('value')} = '', false))"
)

BUTTON = (
    Check("BUTTON_NO_TEXT", unnamed_buttons("e.tag = 'button'"), lit(vocab.MSG_BUTTON_NO_TEXT)),
    Check("BUTTON_NO_TEXT", UNNAMED_INPUTS, printf(vocab.MSG_INPUT_NO_TEXT, attr("type")), loop=1),
    Check("BUTTON_NO_TEXT", unnamed_buttons(f"{attr('role')} = 'button'"), lit(vocab.MSG_ROLE_BUTTON_NO_TEXT), loop=2),
)

# -- document structure ---------------------------------------------------------------------

SEVERAL_H1 = on_page(
    "size(h1s) > 1",
    "size(h1s) AS n, array_join(transform(slice(h1s, 1, 3), "
    f"e -> substring(e.markup, 1, {vocab.H1_CONTEXT_CHARS})), ', ') AS shown",
)

DOCUMENT_STRUCTURE = (
    Check("MISSING_TITLE", on_page(f"NOT coalesce(get({by_tag('title')}, 0).has_text, false)"),
          lit(vocab.MSG_MISSING_TITLE), lit(vocab.CONTEXT_HEAD)),
    Check("MISSING_MAIN", on_page(f"NOT {exists(IS_MAIN)}"), lit(vocab.MSG_MISSING_MAIN), lit(vocab.CONTEXT_BODY),
          loop=1),
    Check("MULTIPLE_H1", SEVERAL_H1, printf(vocab.MSG_MULTIPLE_H1, "e.n"), "e.shown", loop=2),
    Check("MISSING_H1", on_page("size(h1s) = 0"), lit(vocab.MSG_MISSING_H1), lit(vocab.CONTEXT_BODY), loop=3),
)

# -- tables ---------------------------------------------------------------------------------

UNNAMED_TABLES = f"filter(data_tables, e -> {all_blank('aria-label', 'aria-labelledby', 'summary')})"
FIRST_UNSCOPED = let(
    "bare_from",
    following(select(f"e.tag = 'th' AND {blank(attr('scope'))}")),
    f"transform(filter(data_tables, e -> {holds_two('headers_from')} AND {holds('bare_from')}), "
    f"e -> struct(e.node_id AS node_id, get(dom, {first_in('bare_from')}).markup AS markup))",
)
UNCAPTIONED = let("captions_from", following(by_tag("caption")), f"filter({UNNAMED_TABLES}, e -> NOT {holds('captions_from')})")

TABLE = (
    Check("TABLE_NO_HEADERS", f"filter(data_tables, e -> NOT {holds('headers_from')})", lit(vocab.MSG_TABLE_NO_HEADERS), step=0),
    Check("TABLE_NO_CAPTION", UNCAPTIONED, lit(vocab.MSG_TABLE_NO_CAPTION), step=1),
    Check("TABLE_MISSING_SCOPE", FIRST_UNSCOPED, lit(vocab.MSG_TABLE_MISSING_SCOPE), step=2),
)

# -- ARIA -----------------------------------------------------------------------------------

ROLES = (
    f"transform({by_attr('role')}, e -> struct(e.node_id AS node_id, e.markup AS markup, "
    f"lower({strip(attr('role'))}) AS role))"
)
HIDDEN = by_attr("aria-hidden", "true")
# Most pages hide nothing; what can be focused is only looked for on the others.
HIDING = let("hidden", HIDDEN, let(
    "focusable_from", f"CASE WHEN size(hidden) > 0 THEN {following(select(FOCUSABLE))} END",
    f"filter(hidden, e -> {holds('focusable_from')})",
))

ARIA = (
    Check("INVALID_ARIA_ROLE", f"filter({ROLES}, e -> e.role <> '' AND NOT e.role IN ({words(vocab.ARIA_ROLES)}))",
          printf(vocab.MSG_INVALID_ARIA_ROLE, "e.role")),
    Check("ARIA_HIDDEN_FOCUSABLE", f"filter({HIDDEN}, e -> {FOCUSABLE})", lit(vocab.MSG_ARIA_HIDDEN_SELF),
          loop=1, step=0),
    Check("ARIA_HIDDEN_FOCUSABLE", HIDING, lit(vocab.MSG_ARIA_HIDDEN_INSIDE), loop=1, step=1),
)

# -- skip links -----------------------------------------------------------------------------

IN_BODY = "e.node_id > body.node_id AND e.node_id <= body.subtree_end"
LINK_WORDS = f"concat(lower(e.text), ' ', coalesce(lower({attr('aria-label')}), ''))"
SKIP_TARGET = " OR ".join(f"startswith({attr('href')}, {lit(target)})" for target in vocab.SKIP_LINK_TARGETS)
SKIP_LINK = (
    f"slice(filter(slice({select(f"e.tag = 'a' AND {attr('href')} IS NOT NULL AND {IN_BODY}")}, "
    f"1, {vocab.SKIP_LINK_WINDOW}), e -> {LINK_WORDS} RLIKE {lit('(?i)' + vocab.SKIP_LINK_PATTERN)} "
    f"OR {SKIP_TARGET}), 1, 1)"
)
SKIP_FRAGMENT = (
    f"transform(filter({SKIP_LINK}, e -> {attr('href')} RLIKE '(?s)^#.'), e -> struct(e.node_id AS node_id, "
    f"e.markup AS markup, substring({attr('href')}, 2) AS target))"
)

SKIP = (
    Check("BROKEN_SKIP_LINK",
          f"filter({SKIP_FRAGMENT}, l -> NOT {exists(f'{attr("id")} = l.target', among='dom')})",
          printf(vocab.MSG_BROKEN_SKIP_LINK, "e.target")),
    Check("NO_SKIP_LINK",
          on_page(f"body IS NOT NULL AND size({SKIP_LINK}) = 0 AND {exists(f'{IN_BODY} AND {IS_NAVIGATION}')} "
                  f"AND {exists(f'{IN_BODY} AND {IS_MAIN}')}"),
          lit(vocab.MSG_NO_SKIP_LINK), lit(vocab.CONTEXT_NAV), loop=1),
)

# -- media ----------------------------------------------------------------------------------


def autoplaying(tag: str) -> str:
    return select(
        f"e.tag = {lit(tag)} AND {attr('autoplay')} IS NOT NULL "
        f"AND {attr('muted')} IS NULL AND {attr('controls')} IS NULL"
    )


CAPTION_TRACKS = select(f"e.tag = 'track' AND {attr('kind')} IN ({words(vocab.CAPTION_TRACK_KINDS)})")

MEDIA = (
    Check("VIDEO_NO_CAPTIONS", let("tracks_from", following(CAPTION_TRACKS), select(f"e.tag = 'video' AND NOT {holds('tracks_from')}")),
          lit(vocab.MSG_VIDEO_NO_CAPTIONS), step=0),
    Check("AUTOPLAY_NO_CONTROLS", autoplaying("video"), lit(vocab.MSG_VIDEO_AUTOPLAY), step=1),
    Check("AUTOPLAY_NO_CONTROLS", autoplaying("audio"), lit(vocab.MSG_AUDIO_AUTOPLAY), loop=1),
)

# -- the older rule set ---------------------------------------------------------------------

LEGACY = (
    Check("IMG_MISSING_ALT", IMAGES_WITHOUT_ALT, lit(vocab.MSG_IMG_MISSING_ALT)),
    Check("LINK_IMG_MISSING_ALT", LINKED_UNNAMED_IMAGES, lit(vocab.MSG_LINK_IMG_MISSING_ALT), loop=1),
    Check("LINK_NO_TEXT", select(f"{TEXTLESS_LINK} AND NOT {holds('images_from')}"),
          lit(vocab.MSG_LINK_NO_TEXT), loop=1, step=1),
    Check("HEADING_ORDER", HEADING_JUMP, lit(vocab.MSG_HEADING_ORDER_LEGACY), HEADING_LEVELS, loop=2),
    Check("FORM_CONTROL_NO_LABEL",
          unlabelled(vocab.LEGACY_UNLABELLED_INPUT_TYPES, ("aria-label", "aria-labelledby")),
          lit(vocab.MSG_FORM_CONTROL_NO_LABEL), loop=3),
)


def default_rules(wcag_level: str = "AA") -> RuleSet:
    return RuleSet([
        Rule("alt_text", "Detect missing alt text on images and linked images", ALT_TEXT),
        Rule("form_labels", "Detect form controls without accessible labels", FORM_LABELS),
        Rule("heading_order", "Detect heading level jumps that confuse screen readers", HEADING_ORDER),
        Rule("contrast", "Detect low contrast in inline style colors", contrast(wcag_level)),
        Rule("link_text", "Detect links missing accessible text", LINK_TEXT),
        Rule("language", "Detect missing or invalid lang attribute on HTML element", LANGUAGE),
        Rule("button", "Detect buttons without accessible names", BUTTON),
        Rule("document_structure",
             "Detect document structure issues (missing landmarks, multiple h1, etc.)", DOCUMENT_STRUCTURE),
        Rule("table", "Detect table accessibility issues (missing headers, captions)", TABLE),
        Rule("aria", "Detect ARIA usage issues (invalid roles, aria-hidden on focusable)", ARIA),
        Rule("skip_link", "Detect missing or broken skip navigation links", SKIP),
        Rule("media", "Detect media accessibility issues (missing captions, transcripts)", MEDIA),
    ])


def legacy_rules() -> RuleSet:
    return RuleSet([Rule("legacy", "The five checks of the older rule set", LEGACY)])


# -- running them ---------------------------------------------------------------------------


def _issues(rule: Rule, position: int, check: Check) -> str:
    return (
        f"transform({check.found}, e -> struct({position} AS analyzer_ord, {check.loop} AS loop_ord, "
        f"e.node_id AS node_id, {check.step} AS check_ord, {lit(rule.name)} AS analyzer, {lit(check.code)} AS code, "
        f"{check.message} AS message, {check.context} AS context))"
    )


def page_issues(doms: DataFrame, rules: RuleSet | None = None, exclude: Iterable[str] = ()) -> DataFrame:
    """One row per page with its ``issues``, in the order the rules report them.

    Excluded rules never enter the plan. Pages without issues keep an empty list.
    """
    active = (rules or default_rules()).active(exclude)
    lists = [_issues(rule, position, check) for position, rule in enumerate(active) for check in rule.checks]
    keys = [name for name in doms.columns if name not in ("dom", "prolog")]
    found = ", ".join([f"cast(array() AS {ISSUE_TYPE})", *lists])
    marked = doms.selectExpr(*keys, "dom", f"{MARKED} AS marked")
    shared = marked.selectExpr(*keys, "dom", "marked", *[f"{made} AS {name}" for name, made in SHARED.items()])
    return shared.selectExpr(*keys, f"cast(array_sort(concat({found})) AS {ISSUE_TYPE}) AS issues")


def page_totals(doms: DataFrame, rules: RuleSet | None = None, exclude: Iterable[str] = ()) -> DataFrame:
    """One row per page with the number of issues found, ``total`` and by severity.

    The severity of a check is known when the plan is made, so lists are only measured: no message or context is put
    together and nothing is sorted.
    """
    known = {row[0]: row[1] for row in vocab.SEVERITY_ROWS}
    sizes: dict[str, list[str]] = {name: [] for name in vocab.SEVERITIES}
    for rule in (rules or default_rules()).active(exclude):
        for check in rule.checks:
            sizes[known.get(check.code, vocab.MINOR)].append(f"size({check.found})")
    keys = [name for name in doms.columns if name not in ("dom", "prolog", "parse_error")]
    marked = doms.selectExpr(*keys, "dom", f"{MARKED} AS marked")
    shared = marked.selectExpr(*keys, "dom", "marked", *[f"{made} AS {name}" for name, made in SHARED.items()])
    counted = shared.selectExpr(*keys, *[f"{' + '.join(['0', *found])} AS {name}" for name, found in sizes.items()])
    return counted.selectExpr(*keys, f"{' + '.join(vocab.SEVERITIES)} AS total", *vocab.SEVERITIES)


def issue_rows(pages: DataFrame) -> DataFrame:
    """One row per issue of the output of ``page_issues``."""
    keys = [name for name in pages.columns if name not in ("issues", "parse_error")]
    # The outer form keeps the optimizer from computing the whole list twice to drop empty ones.
    rows = pages.select(*keys, F.explode_outer("issues").alias("issue"))
    return rows.where("issue IS NOT NULL").select(*keys, "issue.*")


def html_rule(
    pages: DataFrame, name: str, analyze: Callable[[str], list[dict]], keys: Iterable[str] = ("page_id", "url"),
    errors: bool = False,
) -> DataFrame:
    """Issues of a user's own Python check over raw markup; a page it fails on contributes none.

    With ``errors`` such a page has a row without a code, and its failure in a column ``error``.
    """
    names = list(keys)
    fields = [pages.schema[key] for key in names]
    schema = T.StructType(fields + [
        T.StructField(column, T.StringType()) for column in ("analyzer", "code", "message", "context", *(["error"] if errors else []))
    ])

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for record in batch.to_dict("records"):
                key, none = [record[k] for k in names], [None] if errors else []
                try:
                    found = list(analyze(record["html"]))
                except Exception as problem:
                    if errors:
                        rows.append([*key, name, None, None, None, f"{type(problem).__name__}: {problem}"])
                    continue
                rows += [[*key, name, i.get("code"), i.get("message"), i.get("context"), *none] for i in found]
            yield pd.DataFrame(rows, columns=schema.names)

    return pages.select(*names, "html").mapInPandas(run, schema)

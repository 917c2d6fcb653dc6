"""Element sets of a page as SQL expressions over its ``dom`` list.

A set is a list of elements in document order. Ids index the list of the page directly, and an element contains those whose ids
follow its own up to ``subtree_end``. Containment is asked by way of ``following``: for a set, the id of its first element at
or after every place of the page. "Has a descendant", "has two" and "first descendant" are then one or two look-ups per element, linear
in the page however deep it is nested.

Conditions are written over one element called ``e``. The built-in rules look through ``marked``, the elements
any of them can be about; paragraphs and the like are passed over once, not once per rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sightline import vocab
from sightline.functions.text import blank, empty, let, lit, words

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


MARKED_TAGS = (
    "html body title main nav a img label input textarea select button iframe table caption tr th video audio track"
).split() + list(HEADINGS)
MARKED_ATTRIBUTES = ("role", "style", "aria-hidden", "tabindex", "contenteditable")
MARKED = (
    f"filter(dom, e -> e.tag IN ({words(MARKED_TAGS)}) OR (size(e.attrs) > 0 "
    f"AND arrays_overlap(map_keys(e.attrs), array({words(MARKED_ATTRIBUTES)}))))"
)


def attr(name: str, e: str = "e") -> str:
    return f"{e}.attrs[{lit(name)}]"


def select(where: str) -> str:
    """Marked elements of the page that satisfy ``where``, in document order."""
    return f"filter(marked, e -> {where})"


def by_tag(*names: str) -> str:
    return select(f"e.tag IN ({words(names)})")


def by_attr(name: str, *values: str) -> str:
    """Elements with the attribute; with ``values``, only those where it has one of them."""
    return select(f"{attr(name)} IN ({words(values)})" if values else f"{attr(name)} IS NOT NULL")


def exists(where: str, among: str = "marked") -> str:
    return f"exists({among}, e -> coalesce({where}, false))"


def ids(elements: str) -> str:
    return f"transform({elements}, e -> e.node_id)"


def _steps(places: str, value: str) -> str:
    """A list over the places of a page up to the last of ``places`` (sorted ids): ``value`` of the next one, ``s``, and its number, ``k``."""
    return let("places", places, (
        f"flatten(transform(places, (s, k) -> array_repeat({value}, s - coalesce(get(places, k - 1), -1))))"
    ))


def following(elements: str) -> str:
    """For every place of the page the id of the first of ``elements`` at or after it; nothing behind the last."""
    return _steps(ids(elements), "s")


def first_in(places: str, e: str = "e") -> str:
    """The id of the first element inside ``e``, by what ``following`` made; null if there is none."""
    return f"nullif(least(get({places}, {e}.node_id + 1), {e}.subtree_end + 1), {e}.subtree_end + 1)"


def holds(places: str, e: str = "e") -> str:
    """Whether ``e`` has one of the elements inside."""
    return f"coalesce(get({places}, {e}.node_id + 1) <= {e}.subtree_end, false)"


def holds_two(places: str, e: str = "e") -> str:
    return f"coalesce(get({places}, get({places}, {e}.node_id + 1) + 1) <= {e}.subtree_end, false)"


def before(places: str) -> str:
    """For every place of the page how many of ``places`` (sorted ids, repeats count) lie before it, up to the last of them."""
    return _steps(places, "k")


def inside(begun: str, ended: str, n: str, e: str = "e") -> str:
    """Whether ``e`` lies inside any of ``n`` elements, by the places ``before`` it at which they begin and end."""
    return f"coalesce(get({begun}, {e}.node_id), {n}) > coalesce(get({ended}, {e}.node_id), {n})"


def all_blank(*names: str, e: str = "e") -> str:
    return "(" + " AND ".join(blank(attr(name, e)) for name in names) + ")"


NAMELESS = f"(NOT e.has_text AND {all_blank('aria-label', 'aria-labelledby', 'title')})"

FOCUSABLE = f"""(CASE
    WHEN e.tag IN ({words(vocab.FOCUSABLE_TAGS)})
        THEN NOT (e.tag = 'a' AND {empty(attr('href'))}) AND {attr('disabled')} IS NULL
    WHEN coalesce({attr('tabindex')} RLIKE {lit(r'^\s*[+-]?\d+\s*$')}, false)
        THEN NOT {attr('tabindex')} RLIKE {lit(r'^\s*-0*[1-9]')}
    ELSE coalesce({attr('contenteditable')} = 'true', false) END)"""

IS_MAIN = f"(e.tag = 'main' OR coalesce({attr('role')} = 'main', false))"
IS_NAVIGATION = f"(e.tag = 'nav' OR coalesce({attr('role')} = 'navigation', false))"


CONTAINER_TAGS = ("a", "button", "label", "table", "video")
IS_CONTAINER = (
    f"(e.tag IN ({words(CONTAINER_TAGS)}) OR {attr('role')} IS NOT NULL OR {attr('aria-hidden')} IS NOT NULL)"
)


def descendants(doms: DataFrame, where: str = "true", containers: str = IS_CONTAINER, facts: tuple[str, ...] = ("tag",)) -> DataFrame:
    """Containment as a relation: one row per container (``container_id``) and element inside it that satisfies ``where``.

    Takes the output of ``with_dom``; keeps the page's columns and, of an element, ``node_id`` and ``facts``. Groups on the page and
    ``container_id`` combine before the shuffle, since the elements of a page are read together.
    """
    keys = [name for name in doms.columns if name not in ("dom", "parse_error", "prolog")]
    shown = ", ".join(f"e.{name} AS {name}" for name in ("node_id", *facts))
    inner = f"filter(slice(dom, c.node_id + 2, c.subtree_end - c.node_id), e -> {where})"
    pairs = f"flatten(transform(filter(dom, e -> {containers}), c -> transform({inner}, e -> struct(c.node_id AS container_id, {shown}))))"
    return doms.select(*keys, F.explode(F.expr(pairs)).alias("pair")).select(*keys, "pair.*")

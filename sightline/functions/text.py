"""String helpers as SQL expressions.

Every function here and in the sibling modules takes SQL expressions and returns one, for use with
``selectExpr``, ``where`` and ``F.expr``. Whole rules become single expressions that way, which keeps
plan building to a few calls however many conditions a rule has.
"""

from __future__ import annotations

from sightline import vocab


def lit(text: str) -> str:
    """A string literal."""
    quoted = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{quoted}'"


def words(values) -> str:
    """A list of string literals, for ``IN (...)``."""
    return ", ".join(map(lit, values))


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def strip(x: str) -> str:
    """Remove white space at both ends, no-break and other Unicode spaces included."""
    return f"regexp_replace({x}, {lit(r'(?U)^\s+|\s+$')}, '')"


def blank(x: str) -> str:
    """Missing, empty, or nothing but white space."""
    return f"coalesce(NOT ({x} RLIKE {lit(r'(?U)\S')}), true)"


def empty(x: str) -> str:
    """Missing or zero characters long."""
    return f"coalesce({x} = '', true)"


def html_escape(x: str) -> str:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = f"replace({x}, {lit(plain)}, {lit(escaped)})"
    return x


def anchor_id(url: str) -> str:
    """An HTML id for a URL; long URLs may share one."""
    return f"substring(regexp_replace({url}, '[^a-zA-Z0-9]', '-'), 1, {vocab.ANCHOR_CHARS})"


def shortened(x: str, limit: int) -> str:
    """The first ``limit`` characters, marked with ``...`` when something was left out."""
    return f"CASE WHEN length({x}) > {limit} THEN concat(substring({x}, 1, {limit}), '...') ELSE {x} END"


def file_name(path: str) -> str:
    return f"element_at(split({path}, '/'), -1)"


def page_file_name(url: str) -> str:
    """File name under which a rewritten page is kept."""
    return f"concat(replace(replace({url}, '://', '_'), '/', '_'), '.html')"

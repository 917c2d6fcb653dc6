"""Turning one page's HTML into element records: the only part of the engine that reads markup.

The tree follows what lenient HTML parsers agree on: implied ``html``/``head``/``body``, implied end
tags, void and raw-text elements, first value of a repeated attribute, stray end tags ignored.
"""

from __future__ import annotations

import re
from html import unescape

TOKEN = re.compile(
    r"<(?:"
    r"!--(?P<comment>.*?)(?:-->|\Z)"
    r"|!(?P<decl>[^>]*+)>?"
    r"|\?(?P<pi>[^>]*+)>?"
    r"|/(?P<end>[A-Za-z][^\s/>]*+)[^>]*+>?"
    r"|(?P<start>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)"
    r")",
    re.S,
)
ATTRIBUTE = re.compile(
    r"([^\s=/>\"'][^\s=/>]*+)\s*+(=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+"
)

VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW_TEXT = {
    tag: re.compile(rf"</{tag}(?=[\s/>])", re.I)
    for tag in "script style title textarea xmp iframe noembed noframes".split()
}
ESCAPABLE = frozenset(("title", "textarea"))
UNSEEN_TEXT = frozenset("script style template rt rp".split())
HEAD_ONLY = frozenset("script style meta link title base noscript template".split())
FRAMES = frozenset("frameset frame noframes".split())
TOKEN_LISTS = frozenset("class accesskey dropzone rel rev".split())

# Which start tags end an open element of the given kind.
_BLOCKS = (
    "address article aside blockquote caption center col colgroup dd details dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr li listing main menu nav ol p pre section table tbody td "
    "tfoot th thead tr ul xmp"
)
_CLOSERS = {
    "p": _BLOCKS,
    "h1 h2 h3 h4 h5 h6": "fieldset form li p table",
    "li": "li",
    "dt dd": "dt dd",
    "a": "a fieldset table td th",
    "b u": "p td th",
    "big s small strike tt": "p",
    "font span": "td th",
    "option": "option optgroup",
    "optgroup": "optgroup",
    "td th": "td th tr tbody thead tfoot",
    "tr": "tr tbody thead tfoot",
    "tbody thead tfoot": "tbody thead tfoot",
    "caption col": "col colgroup thead tbody tfoot tr",
    "colgroup": "colgroup thead tbody tfoot tr",
    "form": "form",
}
CLOSED_BY = {
    name: frozenset(starts.split()) for names, starts in _CLOSERS.items() for name in names.split()
}
# An end tag does not reach across an open element that outranks it.
END_RANK = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190}

NAMED_TEXT = frozenset("a button title label h1 h2 h3 h4 h5 h6".split())
QUOTED_TAGS = frozenset(
    "html img a input textarea select button h1 h2 h3 h4 h5 h6 table th video audio".split()
)
QUOTED_ATTRIBUTES = frozenset(("style", "role", "aria-hidden"))


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def start_tag(tag: str, attrs: dict[str, str]) -> str:
    parts = [tag]
    for name, value in attrs.items():
        if name in TOKEN_LISTS:
            value = " ".join(value.split())
        value = escape(value)
        if '"' not in value:
            parts.append(f'{name}="{value}"')
        elif "'" not in value:
            parts.append(f"{name}='{value}'")
        else:
            value = value.replace('"', "&quot;")
            parts.append(f'{name}="{value}"')
    return f"<{' '.join(parts)}{'/' if tag in VOID else ''}>"


def attributes(source: str) -> tuple[dict[str, str], bool]:
    """Attributes of a start tag, and whether it closes itself."""
    attrs: dict[str, str] = {}
    end = 0
    for match in ATTRIBUTE.finditer(source):
        name, _, double, single, bare = match.groups()
        value = double or single or bare or ""
        attrs.setdefault(name.lower(), unescape(value) if "&" in value else value)
        end = match.end()
    return attrs, "/" in source[end:]


class Page:
    """Element records of one page, as parallel lists in document order."""

    def __init__(self, html: str):
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.end: list[int] = []
        self.attrs: list[dict[str, str]] = []
        self._texts: list[str] = []
        self._text_span: list[list[int]] = []
        self._out: list[str] = []
        self._length = 0
        self._span: list[list[int]] = []
        self._open: list[int] = []
        self._counts: dict[str, int] = {}
        self._unseen = 0
        self.left_out = 0
        self._root = self._head = self._body = -1
        self._read(html)
        while self._open:
            self._pop()
        self.canonical = "".join(self._out)

    # -- what the element table is built from ------------------------------------------
    def has_text(self, i: int) -> bool:
        first, last = self._text_span[i]
        return last > first

    def text(self, i: int) -> str | None:
        if self.tag[i] in NAMED_TEXT or self.attrs[i].get("role") == "button":
            return "".join(self._texts[slice(*self._text_span[i])])
        return None

    def markup(self, i: int, limit: int) -> str | None:
        if self.tag[i] in QUOTED_TAGS or not QUOTED_ATTRIBUTES.isdisjoint(self.attrs[i]):
            first, _, last = self._span[i]
            return self.canonical[first : min(last, first + limit)]
        return None

    def outer_len(self, i: int) -> int:
        return self._span[i][2] - self._span[i][0]

    def pieces(self, i: int) -> tuple[str, str]:
        """The start tag, and everything up to the next start tag."""
        first, opened, _ = self._span[i]
        following = self._span[i + 1][0] if i + 1 < len(self._span) else len(self.canonical)
        return self.canonical[first:opened], self.canonical[opened:following]

    def start(self, i: int) -> int:
        """Where the element begins in the canonical markup."""
        return self._span[i][0]

    def prolog(self) -> str:
        return self.canonical[: self._span[0][0]] if self._span else self.canonical

    # -- building ------------------------------------------------------------------------
    def _write(self, markup: str) -> None:
        self._out.append(markup)
        self._length += len(markup)

    def _push(self, tag: str, attrs: dict[str, str]) -> int:
        node = len(self.tag)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.parent.append(self._open[-1] if self._open else -1)
        self.depth.append(len(self._open))
        self.end.append(node)
        self._text_span.append([len(self._texts), len(self._texts)])
        first = self._length
        self._write(start_tag(tag, attrs))
        self._span.append([first, self._length, self._length])
        if tag not in VOID:
            self._open.append(node)
            self._counts[tag] = self._counts.get(tag, 0) + 1
            self._unseen += tag in UNSEEN_TEXT
        return node

    def _pop(self) -> None:
        node = self._open.pop()
        tag = self.tag[node]
        self._counts[tag] -= 1
        self._unseen -= tag in UNSEEN_TEXT
        self._write(f"</{tag}>")
        self.end[node] = len(self.tag) - 1
        self._text_span[node][1] = len(self._texts)
        self._span[node][2] = self._length

    def _need_root(self) -> None:
        if self._root < 0:
            self._root = self._push("html", {})

    def _need_body(self) -> None:
        self._need_root()
        if self._body < 0:
            while len(self._open) > 1:
                self._pop()
            self._body = self._push("body", {})

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "html":
            if self._root < 0:
                self._root = self._push(tag, attrs)
        elif tag == "head":
            self._need_root()
            if self._head < 0 and self._body < 0:
                self._head = self._push(tag, attrs)
        elif tag == "body":
            if self._body < 0:
                self._need_root()
                while len(self._open) > 1:
                    self._pop()
                self._body = self._push(tag, attrs)
        else:
            if self._body < 0:
                if tag in HEAD_ONLY:
                    self._need_root()
                    if self._head < 0:
                        self._head = self._push("head", {})
                elif tag in FRAMES:
                    self._need_root()
                elif not self._counts.get("noscript") and not self._counts.get("template"):
                    self._need_body()
            while self._open and tag in CLOSED_BY.get(self.tag[self._open[-1]], ()):
                self._pop()
            self._push(tag, attrs)

    def _finish(self, tag: str) -> None:
        if tag in ("html", "body") or not self._counts.get(tag):
            return
        rank = END_RANK.get(tag, 200 if tag == "head" else 100)
        for position in range(len(self._open) - 1, -1, -1):
            name = self.tag[self._open[position]]
            if name == tag:
                while len(self._open) > position:
                    self._pop()
                return
            if END_RANK.get(name, 100) > rank:
                return

    def _text(self, raw: str, decode: bool = True) -> None:
        text = unescape(raw) if decode and "&" in raw else raw
        stripped = text.strip()
        top = self.tag[self._open[-1]] if self._open else None
        if top in (None, "html", "head"):
            if not stripped:
                return
            if self._body < 0:
                self._need_body()
                self._push("p", {})
        if stripped and not self._unseen:
            self._texts.append(stripped)
        self._write(escape(text) if decode else text)

    def _read(self, html: str) -> None:
        position, size = 0, len(html)
        while position < size:
            match = TOKEN.search(html, position)
            if match is None:
                self._text(html[position:])
                return
            if match.start() > position:
                self._text(html[position : match.start()])
            position = match.end()
            kind = match.lastgroup
            if kind == "attrs":
                if html[position - 1] != ">":
                    self.left_out = size - match.start()  # the page ends inside a tag
                    return
                tag = match["start"].lower()
                attrs, closed = attributes(match["attrs"]) if match["attrs"] else ({}, False)
                self._start(tag, attrs)
                if closed and tag not in VOID:
                    self._finish(tag)
                elif tag in RAW_TEXT:
                    stop = RAW_TEXT[tag].search(html, position)
                    last = stop.start() if stop else size
                    if last > position:
                        self._text(html[position:last], decode=tag in ESCAPABLE)
                    position = last
            elif kind == "end":
                self._finish(match["end"].lower())
            elif kind == "comment":
                self._write(f"<!--{match['comment']}-->")
            elif kind == "decl" and match["decl"][:7].lower() == "doctype":
                self._write(f"<!DOCTYPE{match['decl'][7:]}>\n")

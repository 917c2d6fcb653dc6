"""Personal data, found by expanding anchors.

One Aho-Corasick automaton finds the anchors of all kinds in a single reading: at-signs, plus signs, digits, schemes and
identifier cues. At each anchor a small deterministic parser looks left and right for the boundaries of an address, number or
account and validates it:

* ``email`` around an at-sign, ``phone`` from a plus sign,
* ``ip`` and ``card`` from the first digit of a run (four parts of at most 255; 16 to 19 digits with a Luhn check digit),
* ``url`` from a scheme, when it names a user (in the authority or in a query parameter),
* ``account`` after a cue: an IBAN that passes modulo 97, or a number of 6 to 17 digits in the cue's sentence.

The first four are leftmost and without overlap within their kind; a match that fails validation is dropped and not retried.
Each text is handled on its own in one pass without a shuffle; batches follow Arrow's limits, so memory follows a batch and its
longest text. Every parser moves forward only, so time is linear in the text.

Defined results: null and empty texts have no spans; repeated rows are scanned one by one; other columns are ignored; an empty
table gives an empty table. Places count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.tables import id_and_text

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "url", "account"]
SCHEMES = ["http://", "https://", "ftp://", "mailto:"]
CUES = ["IBAN", "iban", "account", "Account", "acct", "Acct", "ACCT", "SSN", "ssn", "passport", "Passport", "konto", "Konto"]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIGITS = re.compile(r"[0-9]+")
URL = re.compile(r"[^\x20\x09-\x0D\"'<>]+")
URL_USER = re.compile(r"//[^/?#@]+@|[?&](?:user|email|login|account|uid|phone)=[^&#]+")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
ACCOUNT = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
CUE_REACH = 24


def find_anchors() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for kind, words in (("@", "@"), ("+", "+"), ("0", "0123456789"), ("url", SCHEMES), ("cue", CUES)):
        for word in words:
            automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def text_spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of all spans, by kind and place."""
    found: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    email_end = run_end = ip_end = card_end = url_end = cue_end = 0
    for last, (kind, length) in anchors.iter(text):
        if kind == "0":
            if last < run_end:
                continue
            run_end = DIGITS.match(text, last).end()
            # A run of digits belongs to the number before it unless that has ended.
            if last >= ip_end and (m := IP.match(text, last)):
                ip_end = m.end()
                if all(len(p) <= 3 and int(p) <= 255 for p in (part.lstrip("0") or "0" for part in m[0].split("."))):
                    found[1].append(m.span())
            if last >= card_end and (m := CARD.match(text, last)):
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found[2].append(m.span())
        elif kind == "@":
            start = last
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < last and (m := DOMAIN.match(text, last + 1)):
                email_end = m.end()
                found[0].append((start, email_end))
        elif kind == "+":
            if m := PHONE.match(text, last):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found[3].append(m.span())
        elif kind == "url":
            start = last + 1 - length
            if start >= url_end and (m := URL.match(text, start)):
                url_end = m.end()
                if URL_USER.search(m[0]):
                    found[4].append(m.span())
        elif last >= cue_end:
            cue_end = _account(text, last + 1, found[5])
    return [(k, *span) for k, spans in enumerate(found) for span in spans]


def _account(text: str, at: int, out: list[tuple[int, int]]) -> int:
    """Takes an account number that begins within reach of a cue; where the next cue may count."""
    reach = at + CUE_REACH
    if m := IBAN.search(text, at, reach + 45):
        if m.start() <= reach:
            for end in range(m.end(), m.start() + 14, -1):
                if text[end - 1] != " " and (end == len(text) or not text[end].isalnum()) and iban_ok(text[m.start():end]):
                    out.append((m.start(), end))
                    return end
    if (m := DIGITS.search(text, at, reach)) and not re.search(r"[.!?\n]", text[at : m.start()]):
        m = ACCOUNT.match(text, m.start())
        if 6 <= sum(c.isdigit() for c in m[0]) <= 17:
            out.append(m.span())
            return m.end()
    return at


def scanned_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end) for every row."""

    def scan(batches: Iterator[pa.RecordBatch]):
        anchors = find_anchors()
        for batch in batches:
            spans = [
                [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in text_spans(text.as_py(), anchors)]
                for text in batch.column("text")
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, SPANS)], ["doc_id", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(scan, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def masked(text: str, anchors: ahocorasick.Automaton) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in text_spans(text, anchors)):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def without_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data masked in the text; null texts stay null."""

    def mask(batches):
        anchors = find_anchors()
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            texts = [None if t is None else masked(t, anchors) for t in batch.column(k).to_pylist()]
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    return docs.mapInArrow(mask, docs.withColumn(text_col, F.col(text_col)).schema)

"""Colours and contrast as SQL expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from sightline import vocab
from sightline.functions.text import let, lit, strip, words

HEX = lit("^#([0-9a-fA-F]{3,6})")
RGB = lit(r"^rgba?\(([^)]+)\)")
HSL = lit(r"^hsla?\(([^)]+)\)")
DECIMAL = lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")


def _hex_color(v: str) -> str:
    digits = f"regexp_extract({v}, {HEX}, 1)"
    return let("digits", digits, (
        "lower(concat('#', CASE WHEN length(digits) = 3 THEN regexp_replace(digits, '(.)', '$1$1') ELSE digits END))"
    ))


def _rgb_channels(v: str) -> str:
    """The three channel numbers; null where a part is not a whole number."""
    parts = f"slice(split(regexp_extract({v}, {RGB}, 1), ','), 1, 3)"
    return f"transform({parts}, part -> try_cast(split({strip('part')}, '%')[0] AS INT))"


def _channels_to_hex(channels: str) -> str:
    """``#rrggbb``; null unless there are three non-negative whole channels."""
    digits = "transform(channels, c -> concat(CASE WHEN c < 16 THEN '0' ELSE '' END, hex(c)))"
    return let("channels", channels, (
        "CASE WHEN size(channels) = 3 AND forall(channels, c -> c IS NOT NULL AND c >= 0) "
        f"THEN concat('#', lower(array_join({digits}, ''))) END"
    ))


def hsl_to_hex(hue: str, saturation: str, lightness: str) -> str:
    """``#rrggbb`` of a hue in turns and saturation and lightness in 0..1."""
    turns = "transform(array(1/3D, 0D, -1/3D), shift -> hsl.h + shift)"
    wrapped = f"transform({turns}, t -> CASE WHEN t < 0 THEN t + 1 WHEN t > 1 THEN t - 1 ELSE t END)"
    level = (
        "CASE WHEN t < 1/6D THEN hsl.p + (hsl.q - hsl.p) * 6 * t WHEN t < 1/2D THEN hsl.q "
        "WHEN t < 2/3D THEN hsl.p + (hsl.q - hsl.p) * (2/3D - t) * 6 ELSE hsl.p END"
    )
    levels = f"CASE WHEN hsl.s = 0 THEN array(hsl.l, hsl.l, hsl.l) ELSE transform({wrapped}, t -> {level}) END"
    channels = f"transform({levels}, x -> try_cast(x * 255 AS INT))"
    upper = "CASE WHEN hsl.l < 0.5D THEN hsl.l * (1 + hsl.s) ELSE hsl.l + hsl.s - hsl.l * hsl.s END"
    base = f"struct({hue} AS h, {saturation} AS s, {lightness} AS l)"
    with_q = let("hsl", base, f"struct(hsl.h AS h, hsl.s AS s, hsl.l AS l, {upper} AS q)")
    with_p = let("hsl", with_q, "struct(hsl.h AS h, hsl.s AS s, hsl.l AS l, hsl.q AS q, 2 * hsl.l - hsl.q AS p)")
    return let("hsl", with_p, _channels_to_hex(channels))


def _hsl_color(v: str) -> str:
    def number(position: int) -> str:
        text = strip(f"get(parts, {position})")
        text = text if position == 0 else f"replace({text}, '%', '')"
        return f"CASE WHEN {strip(text)} RLIKE {DECIMAL} THEN try_cast({strip(text)} AS DOUBLE) END"

    numbers = f"struct({number(0)} / 360 AS h, {number(1)} / 100 AS s, {number(2)} / 100 AS l)"
    known = "v3.h IS NOT NULL AND v3.s IS NOT NULL AND v3.l IS NOT NULL"
    return let("parts", f"split(regexp_extract({v}, {HSL}, 1), ',')", let(
        "v3", numbers, f"CASE WHEN {known} THEN {hsl_to_hex('v3.h', 'v3.s', 'v3.l')} END"))


def parse_color(value: str) -> str:
    """A CSS colour as hex digits after ``#``; null where it is not understood."""
    names = ", ".join(f"{lit(name)}, {lit(color)}" for name, color in vocab.NAMED_COLORS.items())
    return let("v", f"lower({strip(value)})", (
        f"CASE WHEN v IN ({words(vocab.NAMED_COLORS)}) THEN element_at(map({names}), v) "
        f"WHEN v RLIKE {HEX} THEN {_hex_color('v')} "
        f"WHEN v RLIKE {RGB} THEN {_channels_to_hex(_rgb_channels('v'))} "
        f"WHEN v RLIKE {HSL} THEN {_hsl_color('v')} END"
    ))


def parse_fix_color(value: str) -> str:
    """The narrower reading used when rewriting pages: hex and rgb only, case-sensitive."""
    return let("v", strip(value), (
        f"CASE WHEN v RLIKE {HEX} THEN {_hex_color('v')} "
        f"WHEN v RLIKE {RGB} THEN {_channels_to_hex(_rgb_channels('v'))} END"
    ))


def malformed_fix_color(value: str) -> str:
    """An rgb() value whose channels cannot be read, which stops the rewriting of its page."""
    return let("v", strip(value), (
        f"coalesce(v RLIKE {RGB} AND NOT v RLIKE {HEX} AND {_channels_to_hex(_rgb_channels('v'))} IS NULL, false)"
    ))


def hex_to_rgb(color: str) -> str:
    """Red, green and blue; a channel without digits is null."""
    def channel(at: int) -> str:
        digits = f"substring({color}, {at}, 2)"
        return f"CASE WHEN length({digits}) > 0 THEN cast(conv({digits}, 16, 10) AS INT) END"

    return f"struct({channel(2)} AS r, {channel(4)} AS g, {channel(6)} AS b)"


def _named(x: str, body: Callable[[str], str]) -> str:
    """``body`` of ``x``; anything longer than a name is computed once first."""
    return body(x) if re.fullmatch(r"[\w.]+|'[^']*'", x) else let("shade", x, body("shade"))


def relative_luminance(color: str) -> str:
    """Weighted brightness; written out plainly, so that on columns it compiles to straight code."""
    def linear(c: str, at: int) -> str:
        s = f"(cast(conv(substring({c}, {at}, 2), 16, 10) AS INT) / 255D)"
        return f"CASE WHEN {s} <= 0.03928D THEN {s} / 12.92D ELSE pow(({s} + 0.055D) / 1.055D, 2.4D) END"

    return _named(color, lambda c: (
        f"(0.2126D * ({linear(c, 2)}) + 0.7152D * ({linear(c, 4)}) + 0.0722D * ({linear(c, 6)}))"
    ))


def luminance_ratio(first: str, second: str) -> str:
    """Contrast of two brightnesses; where many colours are compared, have these computed in a projection of their own."""
    a, b = f"({first} + 0.05D)", f"({second} + 0.05D)"
    return f"CASE WHEN {a} >= {b} THEN {a} / {b} ELSE {b} / {a} END"


def contrast_ratio(first: str, second: str) -> str:
    """Contrast of two colours, 1 to 21; null where either cannot be read."""
    return luminance_ratio(relative_luminance(first), relative_luminance(second))


def foreground_on(luminance: str) -> str:
    """Black where it is readable on a background of this brightness, white otherwise."""
    readable = f"({luminance_ratio('0D', luminance)}) >= {vocab.CONTRAST_THRESHOLDS['AA']}D"
    return f"CASE WHEN {readable} THEN '#000000' WHEN NOT {readable} THEN '#ffffff' END"


def recommend_foreground(background: str) -> str:
    """Black where it is readable on ``background``, white otherwise."""
    return _named(background, lambda color: foreground_on(relative_luminance(color)))


def style_declarations(style: str) -> str:
    """Declarations of an inline style as ``array<struct<name, value>>``, repeats kept."""
    name = f"lower({strip("substring(part, 1, instr(part, ':') - 1)")})"
    value = strip("substring(part, instr(part, ':') + 1)")
    return (
        f"transform(filter(split({style}, ';'), part -> contains(part, ':')), "
        f"part -> struct({name} AS name, {value} AS value))"
    )


def last_value(declarations: str, *names: str) -> str:
    """Value of the last declaration of any of ``names``; null where there is none."""
    return f"get(reverse(filter({declarations}, d -> d.name IN ({words(names)}))), 0).value"

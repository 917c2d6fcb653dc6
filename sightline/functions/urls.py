"""URL parts and resolution as SQL expressions.

Built on regular expressions, not on the URL functions: those reject the lenient URLs pages contain.
"""

from __future__ import annotations

from sightline.functions.text import let, lit

# 1 scheme and colon, 2 authority with slashes, 3 path, 4 query
PARTS = lit("^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)([?][^#]*)?")


def _part(url: str, group: int) -> str:
    return f"regexp_extract({url}, {PARTS}, {group})"


def netloc(url: str) -> str:
    """Authority, port included; empty where there is none."""
    return f"substring({_part(url, 2)}, 3)"


def path(url: str) -> str:
    """Path without query and fragment; ``/`` where there is none."""
    return f"coalesce(nullif({_part(url, 3)}, ''), '/')"


def without_fragment(url: str) -> str:
    return f"substring_index({url}, '#', 1)"


def valid_scan_url(url: str) -> str:
    return f"coalesce({url} RLIKE '(?i)^https?://[^/?#]+', false)"


def _clean_path(whole: str) -> str:
    """Apply ``.`` and ``..``; paths without them are left as they are."""
    walked = (
        "aggregate(segments, cast(array() AS ARRAY<STRING>), (done, part) -> CASE "
        "WHEN part = '.' THEN done "
        "WHEN part = '..' AND size(done) > 1 THEN slice(done, 1, size(done) - 1) "
        "WHEN part = '..' THEN done "
        "ELSE array_append(done, part) END)"
    )
    ending = "CASE WHEN element_at(segments, -1) IN ('.', '..') THEN '/' ELSE '' END"
    cleaned = let("segments", "split(whole, '/')", f"concat(array_join({walked}, '/'), {ending})")
    dotted = lit(r"(^|/)\.\.?(/|$)")
    return let("whole", whole, f"CASE WHEN whole RLIKE {dotted} THEN {cleaned} ELSE whole END")


def resolve_url(base: str, href: str) -> str:
    """``href`` as seen from the page at ``base``; the fragment is kept."""
    link = f"regexp_replace({href}, {lit(r'^[\x00-\x20]+|[\t\r\n]')}, '')"
    parts = (
        f"struct({link} AS href, {base} AS base, {_part(base, 1)} AS scheme, {_part(base, 2)} AS host, "
        f"{_part(base, 3)} AS path, {_part(base, 4)} AS query)"
    )
    own_scheme = _part("u.href", 1)
    own_path = "regexp_extract(u.href, '^([^?#]*)', 1)"
    rest = "regexp_extract(u.href, '(?s)^([^?#]*)(.*)$', 2)"
    folder = "coalesce(nullif(regexp_extract(u.path, '^(.*/)[^/]*$', 1), ''), '/')"
    relative = f"regexp_replace(concat({folder}, {own_path}), '//+', '/')"
    return let("u", parts, (
        "CASE WHEN u.href = '' THEN u.base "
        f"WHEN {own_scheme} <> '' THEN CASE WHEN lower({own_scheme}) = u.scheme "
        f"THEN concat(u.scheme, substring(u.href, length(u.scheme) + 1)) ELSE u.href END "
        "WHEN startswith(u.href, '//') THEN concat(u.scheme, u.href) "
        f"WHEN startswith(u.href, '/') THEN concat(u.scheme, u.host, {_clean_path(own_path)}, {rest}) "
        "WHEN startswith(u.href, '?') THEN concat(u.scheme, u.host, u.path, u.href) "
        "WHEN startswith(u.href, '#') THEN concat(u.scheme, u.host, u.path, u.query, u.href) "
        f"ELSE concat(u.scheme, u.host, {_clean_path(relative)}, {rest}) END"
    ))

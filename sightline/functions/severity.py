"""Severity look-ups as SQL expressions."""

from __future__ import annotations

from sightline import vocab
from sightline.functions.text import lit


def _lookup(code: str, position: int) -> str:
    pairs = ", ".join(f"{lit(row[0])}, {lit(row[position])}" for row in vocab.SEVERITY_ROWS)
    return f"element_at(map({pairs}), coalesce({code}, ''))"


def severity_of(code: str) -> str:
    """Severity of an issue code; unknown codes are minor."""
    return f"coalesce({_lookup(code, 1)}, {lit(vocab.MINOR)})"


def wcag_of(code: str) -> str:
    return _lookup(code, 2)


def wcag_name_of(code: str) -> str:
    return _lookup(code, 3)


def impact_of(code: str) -> str:
    return _lookup(code, 4)


def severity_rank(severity: str) -> str:
    """0 critical, 1 major, 2 everything else."""
    return f"CASE {severity} WHEN 'critical' THEN 0 WHEN 'major' THEN 1 ELSE 2 END"


def _by_severity(severity: str, table: dict[str, str], default: str) -> str:
    branches = " ".join(f"WHEN {lit(name)} THEN {lit(value)}" for name, value in table.items())
    return f"CASE {severity} {branches} ELSE {lit(default)} END"


def severity_color(severity: str) -> str:
    return _by_severity(severity, vocab.SEVERITY_COLORS, vocab.DEFAULT_COLOR)


def severity_emoji(severity: str) -> str:
    return _by_severity(severity, vocab.SEVERITY_EMOJI, vocab.DEFAULT_EMOJI)


def status_class(total: str, critical: str) -> str:
    return f"CASE WHEN {total} = 0 THEN 'success' WHEN {critical} = 0 THEN 'warning' ELSE 'danger' END"

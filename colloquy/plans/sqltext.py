"""Small builders for the DuckDB oracle text (string literals, CASE chains)."""

from __future__ import annotations

from collections.abc import Iterable


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def first_match(expr: str, terms: Iterable[str], lower: bool = True) -> str:
    """CASE chain returning the first term contained in ``expr``."""
    subject = f"lower({expr})" if lower else expr
    whens = " ".join(f"WHEN contains({subject}, {lit(t.lower() if lower else t)}) THEN {lit(t)}" for t in terms)
    return f"(CASE {whens} END)"


def any_contains(expr: str, needles: Iterable[str]) -> str:
    parts = [f"contains({expr}, {lit(n)})" for n in needles]
    return "(" + " OR ".join(parts) + ")" if parts else "FALSE"


def round_fixed(expr: str, digits: int) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(38,6)), {digits}) AS DOUBLE)"


def six(expr: str) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(38,6)) AS DOUBLE)"

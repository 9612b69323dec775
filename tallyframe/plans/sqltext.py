"""Snippets of SQL that the SQL twins share."""

from __future__ import annotations


def money(expression: str) -> str:
    """An exact sum of amounts in cents, as a double."""
    return f"CAST(SUM(CAST({expression} AS DECIMAL(18,2))) AS DOUBLE)"


def mean(x: str) -> str:
    """The mean from an exact sum."""
    return f"CAST(SUM(CAST({x} AS DECIMAL(29,9))) AS DOUBLE) / COUNT({x})"


def number(x: str, decimals: int = 0) -> str:
    return (
        f"CASE WHEN {x} >= 1000000 THEN printf('%.1fM', {x} / 1000000.0)"
        f" WHEN {x} >= 1000 THEN printf('%.1fK', {x} / 1000.0)"
        f" ELSE format('{{:,.{decimals}f}}', CAST({x} AS DOUBLE)) END"
    )


def currency(x: str) -> str:
    return (
        f"CASE WHEN {x} >= 1000000 THEN printf('$%.2fM', {x} / 1000000.0)"
        f" WHEN {x} >= 1000 THEN printf('$%.1fK', {x} / 1000.0)"
        f" ELSE '$' || format('{{:,.2f}}', CAST({x} AS DOUBLE)) END"
    )


def pct(x: str, decimals: int = 1) -> str:
    return f"printf('%.{decimals}f%%', CAST({x} AS DOUBLE))"


def signed(x: str, decimals: int = 1) -> str:
    return f"printf('%+.{decimals}f%%', CAST({x} AS DOUBLE))"


def week(x: str) -> str:
    start = f"CAST(date_trunc('week', {x}) AS DATE)"
    return f"strftime({start}, '%Y-%m-%d') || '/' || strftime({start} + 6, '%Y-%m-%d')"


def growth(current: str, previous: str) -> str:
    return f"CASE WHEN {previous} IS NULL OR {previous} = 0 THEN 0.0 ELSE ({current} - {previous}) / CAST({previous} AS DOUBLE) * 100 END"


NUMBER = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"


def to_number(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {NUMBER}) THEN TRY_CAST(TRIM({x}) AS DOUBLE) END"


def to_date(x: str) -> str:
    return f"COALESCE(try_strptime({x}, '%Y-%m-%d'), try_strptime({x}, '%m/%d/%Y'))"

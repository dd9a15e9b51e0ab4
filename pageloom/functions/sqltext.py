"""SQL expression text for rules over node arrays.

Nested lambdas are clearer as SQL than as chained Column calls, and one ``F.expr`` replaces thousands
of calls into the JVM while a plan is built. Functions ending in ``_sql`` take and return SQL text.
"""

from __future__ import annotations

from collections.abc import Iterable

from pageloom.constants import WHITESPACE


def lit(text: str) -> str:
    """String literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lits(values: Iterable[str]) -> str:
    return ", ".join(lit(v) for v in values)


def bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once per row.

    Catalyst merges projections, so a costly expression read inside a lambda would otherwise run
    once per array element.
    """
    return f"get(transform(array({value}), {name} -> {body}), 0)"


_SPACES = "'" + "".join(f"\\u{ord(c):04x}" for c in WHITESPACE) + "'"


def strip_sql(x: str) -> str:
    """Trim every Unicode white-space character from both ends."""
    return f"btrim({x}, {_SPACES})"

"""Predicates over a fetched body (F1, F2)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pageloom.constants import BLOCK_CODES, BLOCK_SIGNATURES, JS_PHRASES
from pageloom.functions.text import contains_any, let


def body_flags(html: Column) -> Column:
    """(signed, needs_js): bot-wall and script phrases of a body, lower-cased once."""
    return let(F.lower(F.coalesce(html, F.lit(""))), lambda body: F.struct(
        contains_any(body, BLOCK_SIGNATURES).alias("signed"), contains_any(body, JS_PHRASES).alias("needs_js")))


def blocked_code(status: Column) -> Column:
    return F.coalesce(status.isin(*BLOCK_CODES), F.lit(False))


def is_blocked(status: Column, html: Column) -> Column:
    """bot-wall status code or a bot-wall phrase in the body."""
    return blocked_code(status) | body_flags(html)["signed"]


def needs_js(html: Column) -> Column:
    """the body says that it needs a script engine."""
    return body_flags(html)["needs_js"]

"""Small Column helpers shared by all rules."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from pageloom.constants import WHITESPACE


def strip(c: Column) -> Column:
    """Trim every Unicode white-space character from both ends (``trim`` removes spaces only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    Catalyst merges projections, so a costly expression read inside a lambda would otherwise run
    once per array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """True when the string holds at least one of the (literal) words.

    Plain substring searches: on whole page bodies several times faster than one alternation.
    """
    return reduce(or_, [c.contains(w) for w in words])


def nth(array: Column, index: Column) -> Column:
    """Zero-based element, null outside the array."""
    return F.get(array, index)


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))

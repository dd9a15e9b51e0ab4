"""Request-string rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pageloom.constants import (
    DEEP_HINTS, FIELD_HINTS, FILE_PHRASES, FILLER_WORDS, FORMATS, INTENT_TYPES, LINK_HINTS,
    PAGINATE_PHRASES,
)
from pageloom.functions.text import contains_any, empty_to_null
from pageloom.functions.urls import authority


def classify_intent(query: Column) -> Column:
    """Type of the request from hint words; matches inside words and inside the URL count."""
    q = F.lower(query)
    return (
        F.when(contains_any(q, LINK_HINTS), "url_list")
        .when(contains_any(q, DEEP_HINTS), "deep_content")
        .when(contains_any(q, FIELD_HINTS), "structured_data")
        .otherwise("page_content"))


def intent_depth(intent_type: Column, suggested: Column | None = None) -> Column:
    """I4: hop limit of a type; a suggested depth only counts for the other two types."""
    other = F.lit(0)
    if suggested is not None:
        other = F.greatest(F.lit(0), F.coalesce(suggested.try_cast("int"), F.lit(0)))
    return F.when(intent_type == "deep_content", 2).when(intent_type == "url_list", 0).otherwise(other)


def content_target(query: Column, url: Column) -> Column:
    """The request without its URL and filler words."""
    rest = F.replace(query, F.coalesce(url, F.lit("")), F.lit(""))
    rest = F.regexp_replace(rest, r"(?iU)\b(" + "|".join(FILLER_WORDS) + r")\b", " ")
    return F.btrim(F.regexp_replace(rest, r"(?U)\s{2,}", " "), F.lit(" ,.?!"))


def output_format_hint(query: Column) -> Column:
    """Output format named in the request, null when none is."""
    q = F.lower(query)
    return (
        F.when(q.contains("csv"), "csv")
        .when(q.contains("markdown") | q.contains(" md "), "md")
        .when(q.contains(" text") | q.contains(" txt"), "text")
        .when(q.contains("json"), "json"))


def output_file_hint(query: Column, url: Column) -> Column:
    """Explicit file name, else ``<host>.<ext>`` when the request asks for a file, else null."""
    named = empty_to_null(F.regexp_extract(query, r"(?iU)\b([\w.-]+\.(?:json|csv|txt|md))\b", 1))
    fmt = output_format_hint(query)
    extension = F.when(fmt == "text", ".txt").otherwise(
        F.concat(F.lit("."), F.coalesce(fmt, F.lit("json"))))
    asked = contains_any(F.lower(query), FILE_PHRASES)
    host = F.replace(authority(url), F.lit("."), F.lit("_"))
    return F.coalesce(named, F.when(asked, F.concat(host, extension)))


def pagination_pages(query: Column) -> Column:
    """I8: page count asked for (``3 pages``), null when none is."""
    return F.regexp_extract(F.lower(query), r"(?U)\b(\d+)\s+pages?\b", 1).try_cast("int")


def pagination_wanted(query: Column) -> Column:
    """I8: true when the request asks to page through results."""
    q = F.lower(query)
    return contains_any(q, PAGINATE_PHRASES) | q.rlike(r"(?U)\b\d+\s+pages?\b")


def valid_intent_type(value: Column) -> Column:
    """Unknown types become ``page_content``."""
    return F.when(value.isin(*INTENT_TYPES), value).otherwise("page_content")


def valid_format(value: Column) -> Column:
    """Lower-cased, trimmed format; null when unknown."""
    v = F.lower(F.btrim(value))
    return F.when(v.isin(*FORMATS), v)

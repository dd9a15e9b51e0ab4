"""Decoding of stored model replies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pageloom.functions.text import strip


def unfence(raw: Column) -> Column:
    """Reply text without its Markdown code fence; replies without one skip the patterns."""
    opened = F.regexp_replace(strip(raw), r"(?mU)^```(?:json)?\s*", "")
    bare = strip(F.regexp_replace(strip(opened), r"(?mU)\s*```$", ""))
    return F.when(raw.contains("```"), bare).otherwise(strip(raw))


def decode_response(raw: Column) -> Column:
    """Reply as VARIANT, null when it is not JSON."""
    return F.try_parse_json(unfence(raw))


def reply_string(decoded: Column, path: str) -> Column:
    """String at ``path`` of a decoded reply; null when absent or JSON null."""
    return F.try_variant_get(decoded, path, "string")


def reply_bool(decoded: Column, path: str) -> Column:
    """Boolean at ``path``; a missing or unreadable value is false."""
    return F.coalesce(F.try_variant_get(decoded, path, "boolean"), F.lit(False))


def reply_int(decoded: Column, path: str) -> Column:
    """Whole number at ``path``, null when absent; decimals are cut."""
    return F.try_variant_get(decoded, path, "double").try_cast("int")

"""Item shaping rules as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from pageloom.functions.text import let, nth, strip

_KEYED = r"(?dU)^(\w[\w_-]*):\s+(.+)$"


def as_fields(fields: Column | Sequence[str]) -> Column:
    """Field names as an array Column without repeats."""
    if isinstance(fields, Column):
        return F.array_distinct(fields)
    return F.array(*[F.lit(f) for f in dict.fromkeys(fields)])


def split_parts(item: Column) -> Column:
    """Pieces between newlines and bars, trimmed, empties dropped."""
    return F.filter(F.transform(F.split(item, r"\n|\|", -1), strip), lambda p: p != "")


def match_key(part: Column, fields: Column | Sequence[str]) -> Column:
    """First field that equals, contains or is contained in the part's ``key:``; null if none."""
    key = F.lower(F.regexp_extract(part, _KEYED, 1))
    hits = F.filter(
        as_fields(fields),
        lambda f: (key != "") & (F.contains(F.lower(f), key) | F.contains(key, F.lower(f))))
    return nth(hits, F.lit(0))


def part_value(part: Column) -> Column:
    """Text after ``key:`` of a keyed part, empty otherwise."""
    return F.regexp_extract(part, _KEYED, 2)


def normalise_values(item: Column, fields: Column | Sequence[str]) -> Column:
    """One value per field, in field order.

    A single field takes the whole item. Otherwise the first keyed part of a field wins, and all
    other parts fill the fields still open from left to right; what is missing is ``""``.
    """
    fs = as_fields(fields)

    def keyed(parts: Column) -> Column:
        return F.transform(parts, lambda p: F.struct(p.alias("text"), match_key(p, fs).alias("field")))

    def place(ps: Column) -> Column:
        """``at``: place of the part that gives each field, 0 when none does."""
        matched = F.transform(ps, lambda p: p["field"])
        at = let(matched, lambda m: F.transform(
            fs, lambda f: F.coalesce(F.array_position(m, f), F.lit(0)).cast("int")))
        return let(at, lambda at_: let(
            F.filter(ps, lambda _, i: ~F.array_contains(at_, i + 1)),
            lambda loose: F.transform(at_, lambda a, i: value(ps, at_, loose, a, i))))

    def value(ps: Column, at: Column, loose: Column, a: Column, i: Column) -> Column:
        open_before = F.size(F.filter(F.slice(at, F.lit(1), i), lambda b: b == 0))
        filled = nth(loose, open_before)["text"]
        return F.when(a > 0, part_value(nth(ps, a - 1)["text"])).otherwise(F.coalesce(filled, F.lit("")))

    many = let(keyed(split_parts(item)), place)
    return F.when(F.size(fs) == 1, F.array(item)).otherwise(many)


def normalise_map(item: Column, fields: Column | Sequence[str]) -> Column:
    """N3 as ``MAP<field, value>`` for jobs whose fields vary by row."""
    fs = as_fields(fields)
    return let(fs, lambda names: F.map_from_arrays(names, normalise_values(item, names)))

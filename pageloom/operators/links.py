"""Links of a page, read from its node array."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom.functions.sqltext import bind, strip_sql
from pageloom.functions.urls import base_sql, resolve_sql
from pageloom.operators.clean import subtree_sql, text_sql


def page_links_sql(nodes: str, url: str) -> str:
    """Array of (pos, text, href): followable anchors, first one per absolute address.

    Repeats are found by sorting on (href, pos) and comparing neighbours, so a page with very many
    links stays cheap.
    """
    hrefs = (f"filter(transform(filter(ns, n -> n.tag = 'a' and try_element_at(n.attrs, 'href') is not null), "
             f"n -> struct({strip_sql('try_element_at(n.attrs, \'href\')')} as href, n.pre as pre)), "
             f"x -> not (x.href = '' or startswith(x.href, '#') or startswith(x.href, 'javascript:') or startswith(x.href, 'mailto:')))")
    resolved = f"transform({hrefs}, (x, i) -> struct(substring_index({resolve_sql('base', 'x.href')}, '#', 1) as href, i as pos, x.pre as pre))"
    firsts = bind(f"array_sort({resolved})", "o", "filter(o, (x, i) -> i = 0 or get(o, i - 1).href <> x.href)")
    ordered = f"array_sort(transform({firsts}, x -> struct(x.pos as pos, x.pre as pre, x.href as href)))"
    text = text_sql(subtree_sql("ns", "get(ns, x.pre)"), "")
    return bind(nodes, "ns", bind(
        base_sql(url), "base", f"transform({ordered}, x -> struct(x.pos as pos, {text} as text, x.href as href))"))


def extract_links(parsed: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per distinct link of a page, in document order."""
    return parsed.select(key, F.expr(f"inline({page_links_sql('nodes', url)})"))

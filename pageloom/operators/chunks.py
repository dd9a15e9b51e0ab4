"""H9: block-level chunks of cleaned pages, within each row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom.constants import CHUNK_CHARS
from pageloom.functions.sqltext import bind, strip_sql
from pageloom.operators.clean import body_sql, join_marks_sql, marks_sql, subtree_sql
from pageloom.operators.html import RAW, TEXT, running_sum_sql

# Characters of the markup of every node with its subtree (null for cut-out nodes): a difference of running sums.
_SIZES = bind(
    "transform(marks, m -> coalesce(length(m.o) + length(m.c), 0))", "own", bind(
        running_sum_sql("own"), "sums",
        "transform(ns, n -> if(n is null, null, get(sums, n.last) - get(sums, n.pre) + get(own, n.pre)))"))


def _blocks_sql(limit: int) -> str:
    """Children of the body and of every oversized element below it, loose texts too, in document order.

    A parent above the limit implies the same for all its ancestors, so one look at the parent
    decides. ``drill`` marks the elements that are replaced by their own children.
    """
    kind = f"(not startswith(n.tag, '#') or (n.tag in ('{TEXT}', '{RAW}') and {strip_sql('n.text')} <> ''))"
    listed = f"{kind} and n.pre > b.pre and n.pre <= b.last and (n.parent = b.pre or get(sizes, n.parent) > {limit})"
    block = (f"struct(n.pre as pre, n.parent as parent, get(sizes, n.pre) as size, "
             f"n.last > n.pre and get(sizes, n.pre) > {limit} as drill)")
    body = bind(body_sql("ns"), "found", "struct(coalesce(found.pre, -1) as pre, coalesce(found.last, size(ns)) as last)")
    return bind(_SIZES, "sizes", bind(
        body, "b", f"transform(filter(ns, n -> coalesce({listed}, false)), n -> {block})"))


def _starts_sql(limit: int) -> str:
    """Indexes of the blocks ``bs`` that open a chunk: greedy fill, closed by every drilled block."""
    joins = f"(acc.open and acc.parent = x.b.parent and acc.chars + x.b.size <= {limit})"
    step = (f"case when x.b.drill then struct(acc.starts as starts, false as open, acc.parent as parent, acc.chars as chars) "
            f"when {joins} then struct(acc.starts as starts, true as open, acc.parent as parent, acc.chars + x.b.size as chars) "
            f"else struct(concat(acc.starts, array(x.at)) as starts, true as open, x.b.parent as parent, x.b.size as chars) end")
    return (f"aggregate(transform(bs, (b, i) -> struct(i as at, b as b)), "
            f"struct(cast(array() as array<int>) as starts, false as open, -1 as parent, 0 as chars), "
            f"(acc, x) -> {step}, acc -> acc.starts)")


def chunks_sql(nodes: str, max_chars: int = CHUNK_CHARS) -> str:
    """Array of chunk strings of a cleaned page."""
    sliced = lambda t: f"transform(sequence(0, greatest(0, length({t}) - 1), {max_chars}), c -> substring({t}, c + 1, {max_chars}))"
    members = "filter(slice(bs, s + 1, coalesce(get(starts, i + 1), size(bs)) - s), b -> not b.drill)"
    text = f"array_join(transform(members, m -> {join_marks_sql(subtree_sql('ns', 'get(ns, m.pre)'))}), '\\n')"
    # a block above the limit has no children (a loose text, say) and is alone in its chunk: slice it
    chunk = bind(text, "t", f"if(get(members, 0).size > {max_chars}, {sliced('t')}, array(t))")
    built = bind(_blocks_sql(max_chars), "bs", bind(
        _starts_sql(max_chars), "starts", f"flatten(transform(starts, (s, i) -> {bind(members, 'members', chunk)}))"))
    whole = join_marks_sql("filter(ns, d -> d is not null)")
    return bind(nodes, "ns", bind(marks_sql("ns"), "marks", bind(
        built, "found", f"if(size(found) > 0, found, {bind(whole, 'page', sliced('page'))})")))


def chunk_pages(cleaned: DataFrame, max_chars: int = CHUNK_CHARS) -> DataFrame:
    """H9: chunks of cleaned pages (see ``clean_pages``): chunk_no from 1, html, n_chars.

    Text directly inside an element that is split up is a block of its own; a text or an element without
    children above the limit, and a page without blocks, is sliced by ``max_chars``. No text is lost.
    """
    key = [c for c in cleaned.columns if c != "nodes"]
    chunks = F.expr(chunks_sql("nodes", max_chars))
    return cleaned.select(*key, F.posexplode(chunks).alias("at", "html")).select(
        *key, (F.col("at") + 1).alias("chunk_no"), "html", F.length("html").alias("n_chars"))

"""Cleaning, text and rendering over node arrays (all row-local, no shuffle).

Cut-out nodes become null entries, so array indexes keep their meaning for every later rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pageloom.constants import CHUNK_CHARS, KEEP_ATTRS, OVERLAY_PATTERNS, STRIP_TAGS
from pageloom.functions.sqltext import bind, lit, lits, strip_sql
from pageloom.operators.html import COMMENT, RAW, TEXT, VOID, inside_sql, nearest_sql, running_sum_sql


def _cut_sql(nodes: str, root: str) -> str:
    """Null out every node ``n`` for which ``root`` holds, and all nodes inside one."""
    flags = f"transform(cs, n -> coalesce({root}, false))"
    kept = bind(inside_sql("cs", "roots"), "gone", "transform(cs, n -> if(get(gone, n.pre), null, n))")
    return bind(nodes, "cs", bind(flags, "roots", f"if(array_contains(roots, true), {kept}, cs)"))


def cut_tags_sql(nodes: str, tags: Sequence[str] = STRIP_TAGS) -> str:
    return _cut_sql(nodes, f"n.tag in ({lits(tags)})")


def cut_overlays_sql(nodes: str, patterns: Sequence[str] = OVERLAY_PATTERNS) -> str:
    key = "lower(concat(coalesce(try_element_at(n.attrs, 'id'), ''), ' ', coalesce(try_element_at(n.attrs, 'class'), '')))"
    hit = bind(key, "k", " or ".join(f"contains(k, {lit(p)})" for p in patterns))
    return _cut_sql(nodes, f"size(n.attrs) > 0 and {hit}")


def strip_tags(parsed: DataFrame, tags: Sequence[str] = STRIP_TAGS) -> DataFrame:
    """H2: cut whole boilerplate subtrees."""
    return parsed.withColumn("nodes", F.expr(cut_tags_sql("nodes", tags)))


def strip_overlays(parsed: DataFrame, patterns: Sequence[str] = OVERLAY_PATTERNS) -> DataFrame:
    """H3: cut consent overlays, found by fragments of their id or class names."""
    return parsed.withColumn("nodes", F.expr(cut_overlays_sql("nodes", patterns)))


def _compact_sql(nodes: str) -> str:
    kept = f"map_filter(n.attrs, (k, v) -> k in ({lits(KEEP_ATTRS)}) or startswith(k, 'data-'))"
    parts = "'pre', n.pre, 'last', n.last, 'parent', n.parent, 'depth', n.depth, 'tag', n.tag"
    return (f"transform({nodes}, n -> if(size(n.attrs) > 0, "
            f"named_struct({parts}, 'attrs', {kept}, 'text', n.text), n))")


def compact_attrs(parsed: DataFrame) -> DataFrame:
    """H4: keep the attributes that identify structure."""
    return parsed.withColumn("nodes", F.expr(_compact_sql("nodes")))


def body_sql(nodes: str) -> str:
    """The body element, null when the document has none."""
    return f"get(filter({nodes}, n -> n.tag = 'body'), 0)"


def clean_sql(nodes: str) -> str:
    """Node array without boilerplate and overlays, attributes compacted, body only."""
    inside = "transform(ns, n -> if(n.pre between b.pre and b.last, n, null))"
    compact = _compact_sql(cut_overlays_sql(cut_tags_sql(nodes)))
    return bind(compact, "ns", bind(body_sql("ns"), "b", f"if(b is null, ns, {inside})"))


def clean_pages(parsed: DataFrame) -> DataFrame:
    """H5: boilerplate and overlays cut, attributes compacted, body only."""
    return parsed.withColumn("nodes", F.expr(clean_sql("nodes")))


def pieces_sql(nodes: str) -> str:
    """Stripped, non-empty text nodes in document order."""
    return f"filter(transform(filter({nodes}, n -> n.tag = '{TEXT}'), n -> {strip_sql('n.text')}), t -> t <> '')"


def text_sql(nodes: str, sep: str) -> str:
    return f"array_join({pieces_sql(nodes)}, {lit(sep)})"


def subtree_sql(nodes: str, node: str) -> str:
    """The node and its descendants; cut-out nodes are null entries and are left out."""
    return f"filter(slice({nodes}, {node}.pre + 1, {node}.last - {node}.pre + 1), d -> d is not null)"


def page_text(parsed: DataFrame) -> DataFrame:
    """H6: visible text, one piece per line, boilerplate left out."""
    key = [c for c in parsed.columns if c != "nodes"]
    return parsed.select(*key, F.expr(text_sql(cut_tags_sql("nodes"), "\n")).alias("text"))


BLOCK_TAGS = [
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dd", "dt", "pre", "blockquote",
    "figcaption", "caption",
]


#: Elements that part a page without saying what they hold.
CONTAINERS = [
    "html", "body", "main", "article", "section", "div", "ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr",
    "form", "fieldset", "figure", "details", "summary", "address", "center", "hr",
]
#: Characters outside links that loose text must bring to count as prose, and what a character in a link costs.
LOOSE_COST, LINK_COST = 100, 3


def _text_blocks_sql() -> str:
    """Blocks of text of the array ``ns`` in document order: text, prose, head, and the characters outside and in links.

    A text belongs to the innermost block tag that it lies in, or else to the nearest element that parts the page;
    texts that follow each other in the same element are one block. Needs the flags ``linked``.
    """
    semantic = f"transform(ns, n -> if(coalesce(n.tag in ({lits(BLOCK_TAGS)}), false), 1, 0))"
    # innermost: no further block tag up to the last node inside
    innermost = "transform(ns, n -> coalesce(get(sem, n.pre) = 1 and get(sums, n.last) = get(sums, n.pre), false))"
    parts = f"transform(ns, (n, i) -> get(inner, i) or coalesce(n.tag in ({lits(BLOCK_TAGS + CONTAINERS)}), false) and not get(within, i))"
    words = (f"transform(filter(ns, n -> n.tag = '{TEXT}' and {strip_sql('n.text')} <> ''), n -> "
             f"struct(get(home, n.pre) as home, {strip_sql('n.text')} as t, get(linked, n.pre) as l))")
    starts = ("filter(transform(words, (w, i) -> if(coalesce(get(words, i - 1).home <> w.home, true), i, null)), s -> s is not null)")
    # the links of a block: a block that lies in a link as a whole is no list of links
    free = "filter(run, w -> not w.l or get(linked, w.home))"
    chars = lambda ws: f"aggregate({ws}, 0, (x, w) -> x + length(w.t))"
    tag = "get(ns, get(run, 0).home).tag"
    block = (f"struct(array_join(transform(run, w -> w.t), ' ') as text, {tag} in ({lits(BLOCK_TAGS)}) as prose, "
             f"{tag} rlike '^(?:h[1-6]|t[dh])$' as head, {chars(free)} as free, {chars('run')} as every)")
    blocks = ("transform(starts, (s, i) -> " + bind("slice(words, s + 1, coalesce(get(starts, i + 1), size(words)) - s)", "run", block) + ")")
    return bind(semantic, "sem", bind(running_sum_sql("sem"), "sums", bind(innermost, "inner", bind(
        inside_sql("ns", "inner"), "within", bind(parts, "parts", bind(nearest_sql("ns", "parts"), "home", bind(
            words, "words", bind(starts, "starts", blocks))))))))


def _stretch_sql(blocks: str) -> str:
    """First and last index of the run of blocks with the largest sum of scores, by one fold; (-1, -1) if none is above 0.

    A block scores its characters outside links less LINK_COST for each in one; loose text also LOOSE_COST,
    once for blocks of it that follow each other.
    """
    gain = f"x.b.free - {LINK_COST} * (x.b.every - x.b.free)"
    alone = f"{gain} - if(x.b.prose, 0, {LOOSE_COST})"
    longer = f"acc.sum + {gain} - if(x.b.prose or acc.loose, 0, {LOOSE_COST})"
    better = "if(m.sum > acc.best, {}, {})"
    step = bind(f"if({longer} >= {alone}, struct({longer} as sum, acc.at as at), struct({alone} as sum, x.i as at))", "m",
                "struct(m.sum as sum, m.at as at, not x.b.prose as loose, greatest(m.sum, acc.best) as best, "
                f"{better.format('m.at', 'acc.first')} as first, {better.format('x.i', 'acc.final')} as final)")
    start = "struct(-1000000000 as sum, 0 as at, false as loose, 0 as best, -1 as first, -1 as final)"
    return f"aggregate(transform({blocks}, (b, i) -> struct(b as b, i as i)), {start}, (acc, x) -> {step})"


def main_text_sql(nodes: str) -> str:
    """Blocks that are headings, cells or hold text outside their links; loose ones inside the densest stretch alone."""
    links = inside_sql("ns", "transform(ns, n -> coalesce(n.tag = 'a', false))")
    kept = "b.prose and (b.head or b.free > 0) or b.free > 0 and i between best.first and best.final"
    found = bind(_text_blocks_sql(), "blocks", bind(_stretch_sql("blocks"), "best", (
        f"array_join(filter(transform(blocks, (b, i) -> if({kept}, b.text, '')), t -> t <> ''), {lit(chr(10))})")))
    return bind(cut_tags_sql(nodes), "ns", bind(links, "linked", bind(
        found, "kept", f"if(kept = '', {text_sql('ns', chr(10))}, kept)")))


def main_text(parsed: DataFrame) -> DataFrame:
    """H7: main content by text density, one block per line; H6 when no block qualifies.

    Headings, cells and blocks of text (paragraphs, list items and the like) stay whatever their length unless
    all their text is links. Text loose in ``div`` and other containers, or beside blocks inside an element, is a
    block of its own and stays inside the stretch of the page with most text outside links: a lone notice does not,
    an article written in ``div`` does. The work grows with the nodes, times the logarithm of the depth.
    """
    key = [c for c in parsed.columns if c != "nodes"]
    return parsed.select(*key, F.expr(main_text_sql("nodes")).alias("text"))


# Rendering -------------------------------------------------------------------------------------

def _escape_sql(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_VOID = lits(sorted(VOID))


def open_sql(n: str) -> str:
    """Start tag, text or comment of one node."""
    attrs = (f"if(size({n}.attrs) > 0, array_join(transform(map_entries({n}.attrs), e -> concat(' ', e.key, '=\"', "
             f"replace({_escape_sql('e.value')}, '\"', '&quot;'), '\"')), ''), '')")
    return (f"case {n}.tag when '{TEXT}' then {_escape_sql(f'{n}.text')} when '{RAW}' then {n}.text "
            f"when '{COMMENT}' then concat('<!--', {n}.text, '-->') "
            f"else concat('<', {n}.tag, {attrs}, if({n}.tag in ({_VOID}), '/>', '>')) end")


def close_sql(tag: str) -> str:
    """End tag of an element, empty for everything else."""
    return f"if(startswith({tag}, '#') or {tag} in ({_VOID}), '', concat('</', {tag}, '>'))"


def marks_sql(nodes: str) -> str:
    """Start and end markup of every node, by index."""
    return f"transform({nodes}, n -> if(n is null, null, struct({open_sql('n')} as o, {close_sql('n.tag')} as c, n.parent as up)))"


def join_marks_sql(run: str) -> str:
    """Markup of ``run`` (whole sibling subtrees) from the array ``marks`` of ``marks_sql``.

    The next node hangs from this node or from one of its ancestors, so what closes between the two
    is this node and as many parents above it as the depths differ. No stack and no sort is needed.
    """
    rise = "r.depth - coalesce(get(rs, i + 1), get(rs, 0)).depth"
    walk = ("aggregate(sequence(0, rise), struct(r.pre as at, '' as t), (s, k) -> struct("
            "get(marks, s.at).up as at, concat(s.t, coalesce(get(marks, s.at).c, '')) as t), s -> s.t)")
    closes = bind(rise, "rise", f"if(rise < 0, '', {walk})")
    return bind(run, "rs", f"array_join(transform(rs, (r, i) -> concat(get(marks, r.pre).o, {closes})), '')")


def render_sql(nodes: str, run: str | None = None) -> str:
    """Markup of the whole array or of ``run``, an array of whole sibling subtrees of it."""
    return bind(nodes, "whole", bind(marks_sql("whole"), "marks", join_marks_sql(run or "filter(whole, d -> d is not null)")))


def render_html(parsed: DataFrame) -> DataFrame:
    """H8: one document string per page."""
    return parsed.withColumn("html", F.expr(render_sql("nodes"))).drop("nodes")


def chunk_text(docs: DataFrame, text: str = "text", max_chars: int = CHUNK_CHARS) -> DataFrame:
    """Fixed-width slices of a text column: all other columns, chunk_no from 1, chunk."""
    key = [c for c in docs.columns if c != text]
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(max_chars))
    sliced = F.transform(starts, lambda s: F.substring(F.col(text), s + 1, F.lit(max_chars)))
    return (
        docs.where(F.length(text) > 0)
        .select(*key, F.posexplode(sliced).alias("at", "chunk"))
        .select(*key, (F.col("at") + 1).alias("chunk_no"), "chunk"))

"""H1: HTML to node arrays, the one Python stage of the library.

``parse_pages`` gives one row per page with its document as an array of nodes in document order.
A node's index in the array is its ``pre`` number, ``last`` is the index of its last descendant and
``depth`` counts its ancestors, so "child of" and "subtree" are array look-ups in the same row; "inside"
is a flag handed down from parent to child (``inside_sql``). An array is linear in the nodes, however deep. Every later rule (cleaning, text, links, chunks, selection) is a
Catalyst expression over that array: no shuffle, and no regrouping of nodes into pages.
``html_nodes`` is the flat form, one row per node.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

NODE = T.StructType([
    T.StructField("pre", T.IntegerType()),
    T.StructField("last", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()),
])

TEXT, RAW, COMMENT = "#text", "#raw", "#comment"

# Elements without content, and start tags that close an open element of the named kinds
# (HTML Standard, optional tags). The search for one to close stops at the listed barriers.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = ("address article aside blockquote details div dl fieldset figcaption figure footer form "
          "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul").split()
_CLOSES = {tag: ("p",) for tag in _BLOCK}
_CLOSES |= {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",),
    "optgroup": ("option", "optgroup"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"),
    "tfoot": ("tbody", "thead", "tr", "td", "th"), "a": ("a",),
}
_BARRIERS = {
    "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",),
    "optgroup": ("select",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"),
    "tbody": ("table",), "tfoot": ("table",), "a": ("td", "th", "table"),
}
_SCOPE = ("td", "th", "table", "button", "caption", "object", "body", "html")
_HEAD_ONLY = frozenset("title meta link base style script noscript".split())
_END_STOPS = frozenset("body td th table".split())
_TABLE_PARTS = frozenset("table tr tbody thead tfoot".split())


# One markup token: comment, declaration, end tag or start tag (quoted values may hold ``>``; the
# second start-tag form takes over when a quote is never closed).
_TOKEN = re.compile(
    r"<(?:(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|/(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|!--(?P<comment>.*?)(?:-->|\Z)|[!?](?P<other>[^>]*)(?:>|\Z)"
    r"|(?P<loose>[a-zA-Z][^\s/>]*)(?P<loose_attrs>[^>]*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s/=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_ATTRS: list[tuple[str, str]] = []
# Elements whose content is text up to their end tag: are entities in it decoded, and where it ends.
_UNPARSED = {
    tag: (decode, re.compile(rf"</{tag}(?=[\s/>])", re.I))
    for tag, decode in (("script", False), ("style", False), ("title", True), ("textarea", True))
}


def _attributes(source: str) -> list[tuple[str, str]]:
    """Name/value pairs in source order; the first value of a repeated name wins."""
    pairs: dict[str, str] = {}
    for name, double, single, bare in _ATTR.findall(source):
        pairs.setdefault(name.lower(), unescape(double or single or bare))
    return list(pairs.items())


class _Nodes:
    """Numbers the nodes of one document; lists in the order of NODE."""

    def __init__(self) -> None:
        self.last: list[int] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.tag: list[str] = []
        self.attrs: list[list[tuple[str, str]] | None] = []
        self.text: list[str | None] = []
        self.open: list[int] = []
        self.seen: set[str] = set()
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # stack places of the open elements by tag

    def _add(self, tag: str, attrs: list[tuple[str, str]] | None, text: str | None) -> None:
        self.last.append(len(self.last))
        self.parent.append(self.open[-1] if self.open else -1)
        self.depth.append(len(self.open))
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.text.append(text)

    def _push(self, tag: str, attrs: list[tuple[str, str]]) -> None:
        self.seen.add(tag)
        pre = len(self.last)
        self._add(tag, attrs, None)
        self.places[tag].append(len(self.open))
        self.open.append(pre)

    def _close_to(self, depth: int) -> None:
        """Close every open element at or above ``depth`` of the stack."""
        end = len(self.last) - 1
        while len(self.open) > depth:
            pre = self.open.pop()
            self.last[pre] = end
            self.places[self.tag[pre]].pop()

    def _in_body(self, tag: str) -> None:
        """Open the html/head/body elements that the source leaves out."""
        if "html" not in self.seen:
            self._push("html", _NO_ATTRS)
        if "body" in self.seen:
            return
        in_head = bool(self.places["head"])
        if tag in _HEAD_ONLY:
            if not in_head and "head" not in self.seen:
                self._push("head", _NO_ATTRS)
        elif not (in_head and tag == TEXT and self.tag[self.open[-1]] != "head"):
            self._close_to(1)
            self._push("body", _NO_ATTRS)

    def _topmost(self, tags: Iterable[str]) -> int:
        """Highest stack place of an open element with one of the tags, -1 without any."""
        return max((self.places[t][-1] for t in tags if self.places[t]), default=-1)

    def _close_implied(self, tag: str) -> None:
        closes = [places for name in _CLOSES.get(tag, ()) if (places := self.places[name])]
        if not closes:
            return
        barrier = self._topmost(_BARRIERS.get(tag, _SCOPE))
        above = [places[at] for places in closes if (at := bisect_right(places, barrier)) < len(places)]
        if above:
            self._close_to(min(above))

    def read(self, html: str) -> None:
        pos, size, search = 0, len(html), _TOKEN.search
        while pos < size:
            token = search(html, pos)
            start = token.start() if token else size
            if start > pos:
                self._text(html[pos:start])
            if token is None:
                break
            pos = token.end()
            kind = token.lastgroup
            if kind == "attrs" or kind == "loose_attrs":
                source = token[kind]
                tag = (token["start"] or token["loose"]).lower()
                self._start(tag, _attributes(source) if source else _NO_ATTRS)
                if tag in _UNPARSED:
                    pos = self._unparsed(tag, html, pos)
            elif kind == "end":
                self._end(token["end"].lower())
            elif kind == "comment":
                self._add(COMMENT, None, token["comment"])
        self._close_to(0)

    def _unparsed(self, tag: str, html: str, pos: int) -> int:
        """Content of a script, style, title or textarea; returns where its end tag starts."""
        close = _UNPARSED[tag][1].search(html, pos)
        stop = close.start() if close else len(html)
        if stop > pos:
            decode = _UNPARSED[tag][0]
            body = html[pos:stop]
            self._add(TEXT if decode else RAW, None, unescape(body) if decode else body)
        return stop

    def _start(self, tag: str, pairs: list[tuple[str, str]]) -> None:
        if tag in ("html", "body", "head"):
            if tag in self.seen or (tag == "head" and "body" in self.seen):
                return
            if tag != "html" and "html" not in self.seen:
                self._push("html", _NO_ATTRS)
            if tag == "body":
                self._close_to(1)
            self._push(tag, pairs)
            return
        if "body" not in self.seen:
            self._in_body(tag)
        self._close_implied(tag)
        if tag in VOID:
            self._add(tag, pairs, None)
        else:
            self._push(tag, pairs)

    def _end(self, tag: str) -> None:
        if tag in ("body", "html"):
            return  # closed at the end of the input, so trailing content stays in the body
        place = self._topmost((tag,))
        if place >= 0 and (tag in _TABLE_PARTS or self._topmost(_END_STOPS) <= place):
            self._close_to(place)

    def _text(self, data: str) -> None:
        if "body" in self.seen or data.strip():
            if "body" not in self.seen:
                self._in_body(TEXT)
            self._add(TEXT, None, unescape(data) if "&" in data else data)


def _node_list(documents: list[str | None]) -> pa.Array:
    """One list of node structs per document."""
    offsets = [0]
    cols: list[list] = [[] for _ in range(6)]
    for html in documents:
        reader = _Nodes()
        if html:
            reader.read(html)
        for col, part in zip(cols, (reader.last, reader.parent, reader.depth, reader.tag, reader.attrs, reader.text)):
            col.extend(part)
        offsets.append(len(cols[0]))
    ints = pa.int32()
    pres = [i for a, b in zip(offsets, offsets[1:]) for i in range(b - a)]
    last, parent, depth, tag, attrs, text = cols
    fields = [
        pa.array(pres, ints), pa.array(last, ints), pa.array(parent, ints), pa.array(depth, ints),
        pa.array(tag, pa.string()), pa.array(attrs, pa.map_(pa.string(), pa.string())),
        pa.array(text, pa.string()),
    ]
    structs = pa.StructArray.from_arrays(fields, names=NODE.names)
    return pa.ListArray.from_arrays(pa.array(offsets, ints), structs)


def parse_pages(pages: DataFrame, html: str = "html", batch_chars: int = 1_000_000) -> DataFrame:
    """Node array per page: all other columns of ``pages`` plus ``nodes``; the HTML is dropped.

    Filter and project ``pages`` first, nothing is pushed through the Python stage. Output batches
    are cut by text size, so a run of large pages does not grow the worker's memory.
    """
    kept = [c for c in pages.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            documents = batch.column(html).to_pylist()
            start, chars = 0, 0
            for i, doc in enumerate(documents):
                chars += len(doc or "")
                if chars >= batch_chars or i == len(documents) - 1:
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(c) for c in kept] + [_node_list(documents[start:i + 1])],
                        names=[*kept, "nodes"])
                    start, chars = i + 1, 0

    schema = T.StructType(
        [f for f in pages.schema.fields if f.name != html]
        + [T.StructField("nodes", T.ArrayType(NODE))])
    return pages.mapInArrow(run, schema)


def html_nodes(parsed: DataFrame) -> DataFrame:
    """Flat form: one row per node with depth, kind (el, text, raw, comment), classes and n_chars."""
    key = [c for c in parsed.columns if c != "nodes"]
    return parsed.select(*key, F.inline("nodes")).select(
        *key, "pre", "last", "parent", "depth",
        F.when(F.col("tag").startswith("#"), F.substring("tag", 2, 10)).otherwise("el").alias("kind"),
        "tag", "attrs", classes(F.col("attrs")).alias("classes"), "text",
        F.length(F.coalesce("text", F.lit(""))).alias("n_chars"))


def inside_sql(nodes: str, flags: str) -> str:
    """Per node: is it flagged, or any of its ancestors (``nodes`` and ``flags``: SQL expressions).

    Each round lets a flag reach twice as far down and doubles the step up, so the rounds grow with the
    logarithm of the depth. Null entries of ``nodes`` have no ancestors.
    """
    deepest = f"coalesce(array_max(transform({nodes}, n -> n.depth)), 0)"
    rounds = f"slice(sequence(0, 31), 1, cast(ceil(log2(1 + {deepest})) as int))"
    start = f"struct({flags} as f, transform({nodes}, n -> coalesce(n.parent, -1)) as up)"
    step = ("struct(transform(s.f, (x, i) -> x or coalesce(get(s.f, get(s.up, i)), false)) as f, "
            "transform(s.up, u -> coalesce(get(s.up, u), -1)) as up)")
    return f"aggregate({rounds}, {start}, (s, k) -> {step}, s -> s.f)"


def running_sum_sql(values: str) -> str:
    """Per entry the sum of all up to it (``values``: an array of whole numbers): sums over doubled lengths."""
    rounds = f"slice(sequence(0, 31), 1, cast(ceil(log2(greatest(1, size({values})))) as int))"
    return (f"aggregate({rounds}, {values}, (s, k) -> "
            "transform(s, (x, i) -> x + coalesce(get(s, i - shiftleft(1, k)), 0)))")


def nearest_sql(nodes: str, parts: str) -> str:
    """Per node the index of the nearest element at or above it that ``parts`` (an array of flags) marks, else of
    its topmost one; by pointer doubling, as in ``inside_sql``."""
    deepest = f"coalesce(array_max(transform({nodes}, n -> n.depth)), 0)"
    rounds = f"slice(sequence(0, 31), 1, cast(ceil(log2(1 + {deepest})) as int))"
    up = f"transform({nodes}, (n, i) -> if(n is null or n.parent < 0 or get({parts}, i), i, n.parent))"
    return f"aggregate({rounds}, {up}, (s, k) -> transform(s, u -> get(s, u)))"


def is_element(node: Column) -> Column:
    return ~node["tag"].startswith("#")


def classes(attrs: Column) -> Column:
    """Class names of an attribute map."""
    value = F.coalesce(F.try_element_at(attrs, F.lit("class")), F.lit(""))
    return F.filter(F.split(value, r"(?U)\s+"), lambda c: c != "")

"""Main text of pages: suffix arrays over all text of each host's pages find what repeats, structure checks the verdict."""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections.abc import Callable
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pageloom.llm.text import SLICE
from pageloom.session import scratch_path

#: Shortest repeated stretch of a host's pages, in tokens, and on how many of its distinct pages it must be: a
#: share of them, since on large hosts real text repeats a few words too, and at least a number.
MIN_TOKENS, MIN_SHARE, MIN_PAGES = 8, 0.25, 2
#: Tokens of one suffix array; hosts with more are dealt over several. Long pages share one of more tokens, so that
#: it has about SHARD_PAGES of them (a share of few pages says little), but LONG_TOKENS at most.
SHARD_TOKENS, SHARD_PAGES, LONG_TOKENS = 1 << 14, 16, 1 << 20
#: Names of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript xmp iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
             "strike strong sub sup time tt u var wbr".split())
DROPPED = RAW | set("head nav footer aside form button select option svg math template object canvas audio video dialog menu "
                    "datalist fieldset".split())
MAIN = {"article", "main"}
#: Words of class, id and role that name what is no main text.
FURNITURE = set("ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
                "notice alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar complementary footer "
                "contentinfo masthead comment comments disqus replies share sharing social related recommended newsletter "
                "subscribe subscription signup login search widget pagination pager toolbar dialog".split())
#: First and last words of a class or id that say whether something is there, not what the element is.
TELLS_WHETHER = set("has have with without no not is hide hidden show".split())
TELLS_STATE = set("open opened closed free enabled disabled active inactive on off left right less".split())
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
_NAMED = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Share of a block's characters in links from which it may be a menu although it is in the article.
LINKED = 0.5


def _names_furniture(value: str) -> bool:
    """Whether a class, id or role names what is no main text; "has-sidebar" or "comments-open" don't."""
    for name in value.split():
        words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
        whether = len(words) > 1 and (words[0] in TELLS_WHETHER or words[-1] in TELLS_STATE)
        if not whether and not FURNITURE.isdisjoint(words):
            return True
    return False


def _told_by(attrs: str) -> tuple[bool, bool, bool]:
    """Whether attributes hide an element, name it as no main text, and make it the main part."""
    hidden = bad = main = False
    for m in _NAMED.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            hidden = True
        elif name in ("class", "id", "role"):
            bad |= _names_furniture(value)
            main |= name == "role" and value == "main"
    return hidden, bad, main


def page_blocks(page: str) -> tuple[list[tuple[str, str, float]], bool]:
    """Blocks (text, zone, share in links) in page order, and whether the page marks its main part.

    zone: main (inside article or main), open (inside nothing telling), furniture. Script, style and
    the like give no block. Unclosed and stray tags are taken as browsers take them, roughly: an end tag
    closes what is open up to its start, a new block ends a paragraph.
    """
    blocks: list[tuple[str, str, float]] = []
    text: list[str] = []
    linked = 0
    marked = False
    # each entry: tag, main, furniture, link
    stack: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]
    counts: dict[str, int] = {}
    zone = "open"

    def flush():
        nonlocal linked
        if text:
            if told := " ".join("".join(text).split()):
                size = sum(len(x) - x.count(" ") for x in text)
                blocks.append((told, zone, min(1.0, linked / max(1, size))))
            text.clear()
        linked = 0

    def pop_to(tag):
        while stack[-1][0] != tag:
            counts[stack.pop()[0]] -= 1
        counts[stack.pop()[0]] -= 1

    def say(raw):
        nonlocal linked, zone
        _, main, bad, link = stack[-1]
        now = "furniture" if bad else "main" if main else "open"
        if now != zone:
            flush()
            zone = now
        told = html.unescape(raw) if "&" in raw else raw
        text.append(told)
        if link:
            linked += len(told) - told.count(" ")

    at, end = 0, len(page)
    last_tag = page.rfind(">")
    while at < end:
        if at > last_tag:  # no tag ends here any more; a comment may begin
            say(page[at:].partition("<!--")[0])
            break
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attrs = m[1] or m[4], m[3] or m[6] or ""
        block = tag not in INLINE
        if block:
            if tag == "br":
                text.append(" ")
                continue
            flush()
        if closing:
            if counts.get(tag):
                pop_to(tag)
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if block and counts.get("p"):
            pop_to("p")
        _, main, bad, link = stack[-1]
        hidden, named, is_main = (False, False, False) if tag in ("html", "body") or not attrs else _told_by(attrs)
        main_here = main or tag in MAIN or is_main
        # the outermost article is the article, whatever its classes say; one inside it may be a comment
        named = named and (main or not main_here)
        bad = bad or tag in DROPPED or hidden or named or tag == "header" and not main
        if (tag in MAIN or is_main) and not bad:
            marked = True
        stack.append((tag, main_here, bad, link or tag == "a"))
        counts[tag] = counts.get(tag, 0) + 1
    flush()
    return blocks, marked


#: Kinds of a block: furniture by structure, undecided by it, settled main text.
FURNISHED, OPEN, SETTLED = "f", "o", "m"
#: Pages whose digests a task remembers, so that it sends copies once.
REMEMBER = 200_000


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def _lines(url: str | None, page: str) -> tuple[str | None, bytes, bytes, list[str]]:
    """host (null if the url has none), page, row, and all blocks of a page, each behind the letter of its kind.

    ``page`` stands for the host and the kept blocks, wherever they are found: copies at other addresses and
    with other menus are one page (without kept blocks, all blocks count). ``row`` stands for the other blocks
    too; the smallest row of a page speaks for it, one that has something outside settled main text first.
    """
    found, marked = page_blocks(page)
    lines, kept, loose = [], [], []
    for text, zone, share in found:
        kind = FURNISHED
        if zone == "main" or zone == "open" and not marked:
            kind = OPEN if zone == "open" or share >= LINKED else SETTLED
            kept.append(f"{kind == OPEN} {text}")
        lines.append(kind + text)
        if kind != SETTLED:
            loose.append(f"{-1 if kind == FURNISHED else len(kept) - 1} {text}")
    host = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", url or "")
    host = host[1].lower() if host else None
    told = kept or ["", *(x[1:] for x in lines)]
    row = (b"\1" if lines and not loose else b"\0") + _digest("\n".join(loose))
    return host, _digest(f"{host!r}\n" + "\n".join(told)), row, lines


def _read(pages: DataFrame, kept: tuple[str, ...], fields: str, make: Callable[[], Callable]) -> DataFrame:
    """The columns of ``kept`` and those of ``fields`` that a function makes from a page's ``_lines``; rows
    for which it gives none are left out. ``make`` runs once in each task and returns the function."""
    new = T.StructType.fromDDL(fields)
    source = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                          F.col("html").cast("string").alias("html"))
    schema = T.StructType([*source.select(*kept).schema.fields, *new.fields])
    kinds = [{"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_()}[f.dataType.simpleString()]
             for f in new]

    def run(batches):
        told = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out = [told(*_lines(url, page or "")) for url, page in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                part = part.filter(pa.array([x is not None for x in out], pa.bool_()))
                made = list(zip(*(x for x in out if x is not None))) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), *(pa.array(x, k) for x, k in zip(made, kinds, strict=True))], names=schema.names)

    return source.mapInArrow(run, schema)


def _words(lines: list[str]) -> int:
    return sum(x.count(" ") + 1 for x in lines)


def _shard_of() -> Column:
    return F.pmod(F.xxhash64("page"), F.col("shards")).cast("int")


def _hosts(pages: DataFrame) -> DataFrame:
    """For each host its shards, the pages a stretch must be on (needed), and on how many at most one may be that
    no shard names (unnamed); of all pages, and (loose) of those with text outside settled main text."""
    def make():
        return lambda host, page, row, lines: (
            (host, page, _words(lines), row[:1] == b"\0") if host is not None and lines else None)

    spark = pages.sparkSession
    path = scratch_path(spark, "told")
    _read(pages, (), "host string, page binary, n int, loose boolean", make).groupBy("host", "page").agg(
        F.max("n").alias("n"), F.max("loose").alias("loose")).write.option("compression", "zstd").parquet(path)
    told = spark.read.parquet(path)
    shards = F.greatest(F.ceil(F.sum("n") / LONG_TOKENS),
                        F.least(F.ceil(F.sum("n") / SHARD_TOKENS), F.ceil(F.count(F.lit(1)) / SHARD_PAGES)))
    hosts = told.groupBy("host").agg(shards.cast("int").alias("shards"), *[
        F.greatest(F.lit(MIN_PAGES), F.ceil(n * MIN_SHARE)).cast("long").alias(name)
        for name, n in (("needed", F.count(F.lit(1))), ("needed_loose", F.count_if("loose")))])
    unnamed = told.join(hosts, "host").groupBy("host", _shard_of().alias("shard")).agg(*[
        F.greatest(F.lit(0), F.ceil(n * MIN_SHARE) - 1).cast("long").alias(name)
        for name, n in (("unnamed", F.count(F.lit(1))), ("unnamed_loose", F.count_if("loose")))
    ]).groupBy("host").agg(F.sum("unnamed").alias("unnamed"), F.sum("unnamed_loose").alias("unnamed_loose"))
    path = scratch_path(spark, "hosts")
    hosts.join(unnamed, "host").write.parquet(path)
    return spark.read.parquet(path)


def _streams(pages: DataFrame) -> DataFrame:
    """host, page, row, and all blocks of each page of a host, packed. A task sends a page again only for a smaller row."""
    def make():
        seen: dict[bytes, bytes] = {}
        codec = pa.Codec("zstd")

        def told(host, page, row, lines):
            if host is None or not lines or page in seen and seen[page] <= row:
                return None
            if len(seen) >= REMEMBER:
                seen.clear()
            seen[page] = row
            packed = "\n".join(lines).encode()
            return host, page, row, len(packed), codec.compress(packed, asbytes=True)
        return told

    return _read(pages, (), "host string, page binary, row binary, size int, packed binary", make)


def suffix_order(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by the first ``depth`` tokens (a power of two), and each suffix's rank; equal ranks
    mean an equal beginning of that many tokens. Made by doubling: ranks of pairs of ranks."""
    rank, width = tokens.astype(np.int64), 1
    while width < depth:
        behind = np.full(len(rank), -1, dtype=np.int64)
        behind[:-width] = rank[width:]
        rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + behind + 1, return_inverse=True)[1].reshape(-1)
        width *= 2
    return np.argsort(rank, kind="stable"), rank


class _Shard:
    """The text of a shard's pages as one suffix array, with ``asked`` stretches as further texts.

    A page gives two texts: what is outside settled main text, and settled main text. Each text ends in a
    token that equals no other, so that no stretch goes from one into the next.
    """

    def __init__(self, table: pa.Table, asked: list[str] = ()):
        codec = pa.Codec("zstd")
        rows: dict[bytes, tuple] = {}
        for page, *row in zip(*(table.column(c).to_pylist() for c in ("page", "row", "size", "packed"))):
            if page not in rows or row < rows[page]:
                rows[page] = row
        self.keys = list(rows)
        self.lines = [codec.decompress(packed, size, asbytes=True).decode().split("\n") for _, size, packed in rows.values()]
        texts, pages, loose = [], [], []
        for n, lines in enumerate(self.lines):
            for outside in (True, False):
                if text := " ".join(x[1:] for x in lines if (x[0] != SETTLED) == outside):
                    texts.append(text)
                    pages.append(n)
                    loose.append(outside)
        self.texts = len(texts)
        split = pc.split_pattern(pa.array([f"{t} \n{n}" for n, t in enumerate([*texts, *asked])], pa.large_string()), " ")
        self.tokens = split.flatten()
        ends = split.offsets.to_numpy()[1:] - 1
        self.starts = split.offsets.to_numpy()[:-1]
        text = np.repeat(np.arange(len(ends)), np.diff(split.offsets.to_numpy()))
        self.order, self.rank = suffix_order(self.tokens.dictionary_encode().indices.to_numpy(zero_copy_only=False), MIN_TOKENS)
        self.whole = np.flatnonzero((ends[text] - np.arange(len(text)) >= MIN_TOKENS) & (text < self.texts))
        self.page = np.array([*pages, *[-1] * len(asked)])[text]
        self.loose = np.array([*loose, *[False] * len(asked)])[text]

    def pages_of(self, at: np.ndarray, kind: np.ndarray, kinds: int) -> np.ndarray:
        """For each kind, on how many pages it is; ``kind`` tells that of the stretches at ``at``."""
        n = max(1, len(self.keys))
        return np.bincount(np.unique(kind * n + self.page[at]) // n, minlength=kinds)

    def found(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where the stretches of some ranks are, which each is, and on how many pages, anywhere and in loose text."""
        number = np.full(len(self.rank), -1)
        number[ranks] = np.arange(len(ranks))
        at = self.whole[number[self.rank[self.whole]] >= 0]
        which, loose = number[self.rank[at]], self.loose[at]
        return at, which, self.pages_of(at, which, len(ranks)), self.pages_of(at[loose], which[loose], len(ranks))


_NAMED_BY = "host string, words string, n bigint, n_loose bigint, unnamed bigint, unnamed_loose bigint"


def _candidates(table: pa.Table) -> pa.Table:
    """The stretches of MIN_TOKENS tokens that MIN_SHARE of a shard's pages have, on how many pages each is, and how
    many could have one unnamed. What the host's pages have in that share is named by one shard at least; a host's
    only shard names what is on enough pages."""
    shard, chosen, unnamed = _Shard(table), np.zeros(0, dtype=np.int64), []
    for needed, at in (("needed", shard.whole), ("needed_loose", shard.whole[shard.loose[shard.whole]])):
        pages = len(shard.keys) if needed == "needed" else len(np.unique(shard.page[shard.loose]))
        unnamed.append(max(0, math.ceil(MIN_SHARE * pages) - 1))
        least = table.column(needed)[0].as_py() if table.column("shards")[0].as_py() == 1 else unnamed[-1] + 1
        # a stretch is on no more pages than places
        at = at[np.bincount(shard.rank[at], minlength=len(shard.rank))[shard.rank[at]] >= least]
        chosen = np.union1d(chosen, np.flatnonzero(shard.pages_of(at, shard.rank[at], 1) >= least))
    # neighbours in the suffix array with a common beginning of MIN_TOKENS stand together: the first of each
    first = shard.order[np.flatnonzero(np.diff(shard.rank[shard.order], prepend=-1))][chosen]
    words = shard.tokens.take(pa.array((first[:, None] + np.arange(MIN_TOKENS)).ravel())).to_pylist()
    words = [" ".join(words[i:i + MIN_TOKENS]) for i in range(0, len(words), MIN_TOKENS)]
    _, _, n, n_loose = shard.found(chosen)
    host = table.column("host")[0].as_py()
    return pa.table({
        "host": pa.array([host] * len(words), pa.string()), "words": pa.array(words, pa.string()),
        "n": pa.array(n, pa.int64()), "n_loose": pa.array(n_loose, pa.int64()),
        "unnamed": pa.array([unnamed[0]] * len(words), pa.int64()), "unnamed_loose": pa.array([unnamed[1]] * len(words), pa.int64())})


_COUNTED = "host string, words string, n bigint, n_loose bigint, places array<struct<page: binary, at: int, n: int>>"
_PLACES = pa.list_(pa.struct([("page", pa.binary()), ("at", pa.int32()), ("n", pa.int32())]))


def _counted(table: pa.Table, asked: pa.Table) -> pa.Table:
    """On how many pages of a shard each asked stretch is, anywhere and outside settled main text, and its places.

    A place tells the first of a page's kept tokens in the stretch and how many; open blocks' tokens count first,
    then those of settled ones. Places without kept tokens are not told.
    """
    out = {"words": [], "n": [], "n_loose": [], "places": []}
    if table.num_rows and asked.num_rows:
        words = asked.column("words").to_pylist()
        shard = _Shard(table, words)
        at, which, n, n_loose = shard.found(shard.rank[shard.starts[shard.texts:]])
        kept = np.full(len(shard.rank), -1)
        text = 0
        for lines in shard.lines:
            told = 0
            for outside in (True, False):
                i = int(shard.starts[text]) if text < shard.texts else 0
                own = [x for x in lines if (x[0] != SETTLED) == outside]
                for x in own:
                    size = x.count(" ") + 1
                    if x[0] != FURNISHED:
                        kept[i:i + size] = np.arange(told, told + size)
                        told += size
                    i += size
                text += bool(own)
        window = kept[at[:, None] + np.arange(MIN_TOKENS)]
        many = (window >= 0).sum(axis=1)
        begin = np.where(window >= 0, window, len(kept)).min(axis=1, initial=len(kept))
        places: list[list] = [[] for _ in words]
        for i in np.flatnonzero(many).tolist():
            places[which[i]].append({"page": shard.keys[shard.page[at[i]]], "at": int(begin[i]), "n": int(many[i])})
        for i in np.flatnonzero(n).tolist():
            out["words"].append(words[i])
            out["n"].append(int(n[i]))
            out["n_loose"].append(int(n_loose[i]))
            out["places"].append(places[i])
    host = table.column("host")[0].as_py() if out["words"] else None
    return pa.table({
        "host": pa.array([host] * len(out["words"]), pa.string()), "words": pa.array(out["words"], pa.string()),
        "n": pa.array(out["n"], pa.int64()), "n_loose": pa.array(out["n_loose"], pa.int64()), "places": pa.array(out["places"], _PLACES)})


def _covered(pages: DataFrame) -> DataFrame:
    """page, spans (at, n, loose) of kept tokens inside stretches on MIN_SHARE of the host's pages; loose: on that
    share of those with text outside settled main text, there.

    Suffix arrays are made over shards of a host's pages, whole pages dealt by their digest; a page is in one
    shard, so the page counts of a stretch add up over shards. Each shard names its candidates; every shard of
    the host counts those that may be on enough pages. Both read the texts from one shuffle. Pages without a host
    have nothing to be compared with and are left out.
    """
    spark = pages.sparkSession
    hosts = _hosts(pages)
    # dealt by host and shard: a join's exchange by host would put all shards of a host into one task
    dealt = _streams(pages).join(hosts, "host").select(
        "host", _shard_of().alias("shard"), "shards", "needed", "needed_loose",
        "page", "row", "size", "packed").repartition("host", "shard")
    sums = [F.sum(c).alias(f"{c}_here") for c in ("n", "n_loose", "unnamed", "unnamed_loose")]
    may = [F.col(f"n{x}_here") + F.col(f"unnamed{x}") - F.col(f"unnamed{x}_here") >= F.col(f"needed{x}") for x in ("", "_loose")]
    candidates = dealt.groupBy("host", "shard").applyInArrow(_candidates, _NAMED_BY).groupBy("host", "words").agg(*sums)
    asked = candidates.join(hosts, "host").where(may[0] | may[1]).select(
        "host", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "words")
    path = scratch_path(spark, "stretches")
    dealt.groupBy("host", "shard").cogroup(asked.groupBy("host", "shard")).applyInArrow(
        _counted, _COUNTED).write.option("compression", "zstd").parquet(path)
    counted = spark.read.parquet(path)
    loose = F.col("n_loose") >= F.col("needed_loose")
    repeated = (
        counted.groupBy("host", "words").agg(
            F.sum("n").alias("n"), F.sum("n_loose").alias("n_loose"), F.max(F.size("places")).alias("kept"))
        .join(hosts, "host").where("kept > 0").where((F.col("n") >= F.col("needed")) | loose)
        .select("host", "words", loose.alias("loose")))
    path = scratch_path(spark, "covered")
    (
        counted.where(F.size("places") > 0).select("host", "words", "places").join(repeated, ["host", "words"])
        .select(F.explode("places").alias("p"), "loose")
        .groupBy("p.page").agg(F.collect_set(F.struct("p.at", "p.n", "loose")).alias("spans"))
        .write.option("compression", "zstd").parquet(path))
    return spark.read.parquet(path)


def _left(words: list[str], gone: list[bool]) -> str:
    """A block without its covered runs; a shorter run than a stretch goes only if it is the whole block
    (else it is where a stretch of the neighbouring block happens to go on)."""
    out, at = [], 0
    for covered, run in groupby(gone):
        n = len(list(run))
        if not covered or n < MIN_TOKENS and n < len(words):
            out += words[at:at + n]
        at += n
    return " ".join(out)


def _checked(lines: str, spans: list[dict] | None) -> tuple[str, int]:
    """Text of a page's kept blocks, and how many of their tokens are in repeated stretches.

    The check of the verdict: what repeats leaves open blocks if it is also furniture by its count outside
    settled main text; settled blocks stay whole.
    """
    blocks = lines.split("\n") if lines else []
    if not spans:
        return " ".join(x[1:] for x in blocks), 0
    size = _words(blocks)
    repeated, gone = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
    for span in spans:
        repeated[span["at"]:span["at"] + span["n"]] = True
        if span["loose"]:
            gone[span["at"]:span["at"] + span["n"]] = True
    out, at = [], 0
    for block in blocks:
        if block[0] == SETTLED:
            out.append(block[1:])
            continue
        words = block[1:].split(" ")
        out.append(_left(words, gone[at:at + len(words)].tolist()))
        at += len(words)
    return " ".join(filter(None, out)), int(repeated.sum())


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_repeated for each row of ``pages`` (page_id, url, html).

    All blocks of all pages of a host meet in suffix arrays, which find the stretches of 8 tokens or more that
    stand on a quarter of its distinct pages, on two at least. Structure checks that verdict: scripts, styles,
    menus, headers, footers, sidebars, notices, adverts, forms and comments, known by their elements or by words
    of class, id and role, are furniture whether they repeat or not; what is inside article or main is settled
    main text and kept whole, also where pages repeat it. The rest is open: blocks of pages that mark no main
    part, and blocks of links inside the main part. Repeated stretches leave open blocks if they stand outside
    settled main text on that share of the pages that have such text; the other runs stay.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by
    one space. Null and empty html give an empty text. ``n_repeated`` counts the tokens of settled and open
    blocks that are in repeated stretches, kept or not. Rows with the same text blocks on one host count as
    one page, whatever their addresses, and each get the text; pages without a host keep their open
    blocks whole; other columns are not read; an empty table gives no rows. Pages are parsed three times, for the
    sizes of hosts, for the arrays and for the texts, which takes less disk than storing what was parsed.
    """
    def make():
        return lambda host, page, row, lines: (page, "\n".join(x for x in lines if x[0] != FURNISHED))

    read = _read(pages, ("page_id", "url"), "page binary, lines string", make)
    joined = read.join(_covered(pages), "page", "left").select("page_id", "url", "lines", "spans")

    def run(batches):
        for batch in batches:
            made = [_checked(lines, spans) for lines, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())],
                names=["page_id", "url", "text", "n_repeated"])

    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_repeated bigint")

"""Selectors over node arrays.

A selector is data: string functions split it into steps, and the selectors of a key (or of a call)
become one tree of steps, in which equal beginnings stand once (``tree_sql``). Trees are built in the
selector table, before pages are joined; a page evaluates each step of the tree once, by one generic
expression, so a table with any number of different selectors runs as one plan and nothing is
collected to the driver. A step keeps one flag per node; a later step asks for the flag of the
parent or of any ancestor. Trees of literal selectors stand in the plan as constants.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from pageloom.functions.sqltext import bind, lit, lits, strip_sql
from pageloom.operators.clean import clean_sql, pieces_sql, subtree_sql, text_sql
from pageloom.operators.html import RAW, TEXT, inside_sql, parse_pages, running_sum_sql

_BRACKET = r"\[(?:[^\]\"']|\"[^\"]*\"|'[^']*')*\]"
_ATTR_TEST = r"\[\s*[\w:-]+\s*(?:[~^$*|]?=\s*(?:\"[^\"]*\"|'[^']*'|[\w-]+)\s*)?\]"
_PLACE = r":(?:last-child|nth-child\([1-9]\d{0,4}\)|nth-last-child\([1-9]\d{0,4}\))"
_TEST = rf"(?:[.#][\w-]+|{_ATTR_TEST}|{_PLACE})"
_SIMPLE = rf"(?:(?:\*|[A-Za-z][\w-]*){_TEST}*|{_TEST}+)"
_COMPLEX = rf"\s*{_SIMPLE}(?:(?:\s*>\s*|\s+){_SIMPLE})*\s*"
CSS = rf"^{_COMPLEX}(?:,{_COMPLEX})*$"

_PREDICATE = r"\[\s*(?:@[\w:-]+\s*(?:=\s*(?:\"[^\"]*\"|'[^']*')\s*)?|contains\(\s*@[\w:-]+\s*,\s*(?:\"[^\"]*\"|'[^']*')\s*\)\s*)\]"
_XSTEP = rf"//?(?:\*|[A-Za-z][\w-]*)(?:{_PREDICATE})*"
XPATH = rf"^(?:{_XSTEP})*(?://?(?:text\(\)|@[\w:-]+))?$"

XPATH_PREFIX = "xpath:"
#: Selectors of a key that are tried on one parse of its pages (about; dealt by hash).
SELECTORS_A_PARSE = 64
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "strong"]


def check_selector(selector: str) -> str:
    """Raise ValueError for a literal selector outside the supported subset."""
    if selector.startswith(XPATH_PREFIX):
        if selector == XPATH_PREFIX or not re.match(XPATH, selector[len(XPATH_PREFIX):]):
            raise ValueError(f"unsupported XPath: {selector}")
    elif not re.match(CSS, selector):
        raise ValueError(f"unsupported CSS selector: {selector}")
    return selector


def supported_sql(selector: str) -> str:
    """Is a selector (CSS, or XPath after ``xpath:``) inside the supported subset."""
    path = f"substring({selector}, {len(XPATH_PREFIX) + 1})"
    return (f"if(startswith({selector}, '{XPATH_PREFIX}'), {path} <> '' and {path} rlike {lit(XPATH)}, "
            f"{selector} rlike {lit(CSS)})")


def _step_sql(text: str, child: str) -> str:
    """(child, tag, ids, classes, attrs, places) of one compound selector or XPath step."""
    value = lambda pattern: f"regexp_extract(t, {lit(pattern)}, 1)"
    double, single, bare = value(r"[=,]\s*\"([^\"]*)\""), value(r"[=,]\s*'([^']*)'"), value(r"=\s*([\w-]+)")
    test = (f"struct(lower({value(r'@?([\w:-]+)\s*[~^$*|=,\]]')}) as name, "
            f"if(contains(t, 'contains('), '*=', {value(r'([~^$*|]?=)')}) as op, "
            f"case when {double} <> '' then {double} when {single} <> '' then {single} else {bare} end as value)")
    attrs = f"transform(regexp_extract_all(w, {lit(_BRACKET)}, 0), t -> {test})"
    # place among the element children of the parent; from the end below zero
    number = "cast(coalesce(nullif(regexp_extract(c, '([0-9]+)', 1), ''), '1') as int)"
    places = f"transform(regexp_extract_all(v, {lit(_PLACE)}, 0), c -> if(contains(c, 'last'), -{number}, {number}))"
    bare_text = f"regexp_replace(w, {lit(_BRACKET)}, '')"
    return bind(text, "w", bind(bare_text, "v", f"struct({child} as child, "
                f"lower(regexp_extract(v, '^([A-Za-z][A-Za-z0-9_-]*)', 1)) as tag, "
                f"regexp_extract_all(v, {lit(r'#([\w-]+)')}, 1) as ids, "
                f"regexp_extract_all(v, {lit(r'\.([\w-]+)')}, 1) as classes, {attrs} as attrs, {places} as places)"))


def _css_steps_sql(selector: str) -> str:
    """Alternatives of a supported CSS selector, each an array of steps."""
    alternatives = f"regexp_extract_all({selector}, {lit(rf'(?:[^,\[]|{_BRACKET})+')}, 0)"
    steps = f"regexp_extract_all(alt, {lit(rf'>?\s*(?:[^\s>\[]|{_BRACKET})+')}, 0)"
    step = _step_sql(f"regexp_replace(s, {lit(r'^>\s*|^\s+')}, '')", "startswith(s, '>')")
    return f"transform({alternatives}, alt -> transform({steps}, s -> {step}))"


_ENDING = r"//?(?:text\(\)|@[\w:-]+)$"


def _xpath_steps_sql(path: str) -> str:
    """Steps of a supported path without its ending, as its only alternative."""
    parts = f"regexp_extract_all(regexp_replace({path}, {lit(_ENDING)}, ''), {lit(rf'//?(?:[^/\[]|{_BRACKET})+')}, 0)"
    step = _step_sql("regexp_replace(s, '^//?', '')", "not startswith(s, '//')")
    return f"array(transform({parts}, s -> {step}))"


def tree_sql(selectors: str) -> str:
    """The tree of an array of selectors: struct(levels, wanted), both empty for an empty array.

    ``levels`` hold the distinct beginnings of all alternatives by their number of steps, each as
    struct(parent, open, step): the place of the beginning one step shorter (-1: none) in the
    levels put end to end, whether a step below asks for any ancestor, and the last step. ``wanted``
    has one struct(selector, supported, path, ending, ends) per selector: ``ends`` are the places of its alternatives,
    ``path`` says it is an XPath, ``ending`` what follows its steps. A selector outside the subset has no ends.
    """
    path = f"startswith(want, '{XPATH_PREFIX}')"
    bare = f"substring(want, {len(XPATH_PREFIX) + 1})"
    alternatives = (f"case when not {supported_sql('want')} then array() when {path} then {_xpath_steps_sql(bare)} "
                    f"else {_css_steps_sql('want')} end")
    ending = f"if({path}, regexp_extract({bare}, {lit(_ENDING)}, 0), '')"
    split = (f"transform({selectors}, want -> struct(want as selector, {supported_sql('want')} as supported, "
             f"{path} as path, {ending} as ending, {alternatives} as alts))")
    begun = "array_distinct(flatten(flatten(transform(split, c -> transform(c.alts, a -> transform(a, (x, i) -> slice(a, 1, i + 1)))))))"
    deepest = "coalesce(array_max(transform(begun, b -> size(b))), 0)"
    grouped = f"transform(slice(sequence(1, greatest({deepest}, 1)), 1, {deepest}), d -> filter(begun, b -> size(b) = d))"
    opened = "exists(listed, q -> size(q) = size(b) + 1 and not element_at(q, -1).child and slice(q, 1, size(b)) = b)"
    node = ("struct(cast(array_position(listed, slice(b, 1, size(b) - 1)) as int) - 1 as parent, "
            f"{opened} as open, element_at(b, -1) as step)")
    wanted = ("transform(split, c -> struct(c.selector, c.supported, c.path, c.ending, "
              "transform(filter(c.alts, a -> size(a) > 0), a -> cast(array_position(listed, a) as int) - 1) as ends))")
    tree = f"struct(transform(grouped, g -> transform(g, b -> {node})) as levels, {wanted} as wanted)"
    return bind(split, "split", bind(begun, "begun", bind(grouped, "grouped", bind("flatten(grouped)", "listed", tree))))


def _constant_sql(value, kind: T.DataType) -> str:
    """A collected value as SQL text."""
    if isinstance(kind, T.ArrayType):
        held = ", ".join(_constant_sql(v, kind.elementType) for v in value)
        return f"array({held})" if held else f"cast(array() as {kind.simpleString()})"
    if isinstance(kind, T.StructType):
        return f"named_struct({', '.join(f'{lit(f.name)}, {_constant_sql(value[f.name], f.dataType)}' for f in kind)})"
    return lit(value) if isinstance(kind, T.StringType) else str(value).lower()


@lru_cache(maxsize=256)
def literal_tree_sql(*selectors: str) -> str:
    """The tree of literal selectors as a constant; ValueError for one outside the subset.

    The optimizer evaluates ``tree_sql`` over the literal row, so there is one rule for tables and literals.
    """
    listed = f"array({lits(check_selector(s) for s in selectors)})"
    found = SparkSession.active().sql(f"select {tree_sql('s')} as tree from values ({listed}) as given(s)")
    return _constant_sql(found.first()["tree"], found.schema["tree"].dataType)


_WORDS = "concat(' ', translate(try_element_at(n.attrs, {name}), '\\t\\r\\n\\f', '    '), ' ')"
_VALUE = "try_element_at(n.attrs, t.name)"
_ATTR_HOLDS = (
    f"({_VALUE} is not null and case when t.op = '' then true when t.op = '=' then {_VALUE} = t.value when t.value = '' then false "
    f"when t.op = '*=' then contains({_VALUE}, t.value) when t.op = '^=' then startswith({_VALUE}, t.value) "
    f"when t.op = '$=' then endswith({_VALUE}, t.value) "
    f"when t.op = '~=' then contains({_WORDS.format(name='t.name')}, concat(' ', t.value, ' ')) "
    f"when t.op = '|=' then {_VALUE} = t.value or startswith({_VALUE}, concat(t.value, '-')) else false end)")
# Does node ``n`` satisfy step ``st`` on its own.
_STEP_HOLDS = (
    "(st.tag = n.tag or (st.tag = '' and not startswith(n.tag, '#'))) "
    "and (size(st.ids) = 0 or forall(st.ids, i -> coalesce(try_element_at(n.attrs, 'id') = i, false))) "
    f"and (size(st.classes) = 0 or forall(st.classes, c -> coalesce(contains({_WORDS.format(name=chr(39) + 'class' + chr(39))}, concat(' ', c, ' ')), false))) "
    f"and (size(st.attrs) = 0 or forall(st.attrs, t -> {_ATTR_HOLDS})) "
    "and (size(st.places) = 0 or forall(st.places, c -> get(places, n.pre).at = if(c > 0, c, get(places, n.pre).of + 1 + c)))")


def places_sql(nodes: str) -> str:
    """Per node struct(at, of): its place from 1 among the element children of its parent, and their number.

    Nodes are sorted by parent, numbered from the first of each run, and sorted back; texts and null
    entries (what cleaning took out) share a run of their own and count nowhere.
    """
    by_parent = f"array_sort(transform({nodes}, (n, i) -> struct(if(n is null or startswith(n.tag, '#'), -2, n.parent) as up, i as i)))"
    starts = "transform(kin, (x, j) -> if(j = 0 or get(kin, j - 1).up <> x.up, 1, 0))"
    firsts = "filter(transform(starts, (x, j) -> if(x = 1, j, null)), j -> j is not null)"
    first, after = "get(firsts, get(run, j) - 1)", "coalesce(get(firsts, get(run, j)), size(kin))"
    back = f"array_sort(transform(kin, (x, j) -> struct(x.i as i, cast(j - {first} + 1 as int) as at, cast({after} - {first} as int) as of)))"
    return bind(by_parent, "kin", bind(starts, "starts", bind(running_sum_sql("starts"), "sums", bind(
        "transform(sums, x -> cast(x as int))", "run", bind(firsts, "firsts", back)))))


_FLAGS = "cast(array() as array<struct<hit: array<boolean>, below: array<boolean>>>)"


def hits_sql(nodes: str, levels: str) -> str:
    """Per place of a tree struct(hit, below): one flag per node, does it match the beginning, and is it
    or any ancestor such a node (null where no step asks)."""
    above = "if(g.parent = -1, null, if(g.step.child, get(acc, g.parent).hit, get(acc, g.parent).below))"
    under = "if(g.parent = -1, not st.child or n.parent = -1, get(above, n.parent))"
    hit = f"transform({nodes}, n -> coalesce({_STEP_HOLDS} and {under}, false))"
    both = bind(hit, "hit", f"struct(hit as hit, if(g.open, {inside_sql(nodes, 'hit')}, null) as below)")
    found = bind(above, "above", bind("g.step", "st", both))
    asked = f"if(exists({levels}, level -> exists(level, g -> size(g.step.places) > 0)), {places_sql(nodes)}, null)"
    return bind(asked, "places", f"aggregate({levels}, {_FLAGS}, (acc, level) -> concat(acc, transform(level, g -> {found})))")


def _css_nodes_sql(nodes: str, hits: str, want: str) -> str:
    """Nodes a wanted CSS selector matches, in document order."""
    return f"filter({nodes}, n -> n is not null and exists({want}.ends, e -> get(get({hits}, e).hit, n.pre)))"


def css_sql(nodes: str, tree: str) -> str:
    """Per CSS selector of a tree struct(selector, found): the matching nodes in document order."""
    found = f"transform(tree.wanted, want -> struct(want.selector as selector, {_css_nodes_sql('ns', 'hits', 'want')} as found))"
    return bind(nodes, "ns", bind(tree, "tree", bind(hits_sql("ns", "tree.levels"), "hits", found)))


def select_css(parsed: DataFrame, selector: str, key: str = "page_id") -> DataFrame:
    """One row per element matching a CSS selector: key, pos (from 0), pre, tag.

    Supported: tag, ``*``, ``.class``, ``#id``, ``[a]``, ``[a=v]`` and the other attribute tests,
    ``:last-child``, ``:nth-child(3)``, ``:nth-last-child(3)`` (places among elements), descendant and ``>`` combinators, and lists with ``,``; anything else raises ValueError.
    """
    found = f"get({css_sql('nodes', literal_tree_sql(selector))}, 0).found"
    hits = f"transform({found}, n -> struct(n.pre as pre, n.tag as tag))"
    return parsed.select(key, F.expr(f"posexplode({hits})").alias("pos", "hit")).select(key, "pos", "hit.*")


def _xpath_texts_sql(nodes: str, hits: str, want: str) -> str:
    """Texts of the nodes a wanted path selects, stripped, empties dropped, in document order."""
    # `//x` after a step also reaches the element itself for attributes, not for text()
    every = f"size({want}.ends) = 0"
    reach = f"if(startswith(e, '//') and not {every}, {inside_sql(nodes, 'flag')}, flag)"
    below = "coalesce(get(reach, n.parent), false)"
    whole = (f"transform(filter({nodes}, n -> get(flag, n.pre)), n -> {strip_sql('array_join(transform(filter(' + subtree_sql(nodes, 'n') + f', d -> d.tag in (\'{TEXT}\', \'{RAW}\')), d -> d.text), \'\')')})")
    pieces = f"transform(filter({nodes}, n -> n.tag in ('{TEXT}', '{RAW}') and ({every} or {below})), n -> {strip_sql('n.text')})"
    value = "try_element_at(n.attrs, substring_index(e, '@', -1))"
    values = (f"transform(filter({nodes}, n -> {value} is not null and ({every} or get(flag, n.pre) "
              f"or (startswith(e, '//') and {below}))), n -> {strip_sql(value)})")
    read = f"case when e = '' then {whole} when contains(e, '@') then {values} else {pieces} end"
    found = bind(f"{want}.ending", "e", bind(f"get({hits}, get({want}.ends, 0)).hit", "flag", bind(reach, "reach", read)))
    return f"if({want}.supported, filter({found}, x -> x <> ''), cast(array() as array<string>))"


def select_xpath(parsed: DataFrame, path: str, key: str = "page_id") -> DataFrame:
    """One row per text a path selects: key, pos, text. Paths outside the subset raise."""
    tree = literal_tree_sql(XPATH_PREFIX + path.removeprefix(XPATH_PREFIX))
    texts = items_sql("nodes", tree)
    return parsed.select(key, F.expr(f"posexplode(get({texts}, 0).items)").alias("pos", "text"))


def record_sql(nodes: str, node: str) -> str:
    """Text of a matched element; an element with an address becomes ``name:``/``url:`` lines."""
    address = (f"coalesce(nullif(try_element_at({node}.attrs, 'href'), ''), nullif(try_element_at({node}.attrs, 'data-href'), ''))")
    heading = f"get(filter(inside, h -> h.tag in ({lits(HEADINGS)}) and h.pre > {node}.pre), 0)"
    first_line = lit(r"^[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*")
    # pieces are stripped and not empty, so the first line of the first one is the first real line
    line = f"coalesce(regexp_extract(get({pieces_sql('inside')}, 0), {first_line}, 0), '')"
    name = bind(heading, "head", f"if(head is null, {line}, {text_sql(subtree_sql(nodes, 'head'), '')})")
    linked = bind(name, "name", "if(name <> '', concat('name: ', name, '\\nurl: ', address), concat('url: ', address))")
    return bind(subtree_sql(nodes, node), "inside", bind(
        address, "address", f"if(address is not null, {linked}, {text_sql('inside', chr(10))})"))


def _items_of_sql(nodes: str, hits: str, want: str) -> str:
    records = f"transform({_css_nodes_sql(nodes, hits, want)}, m -> {record_sql(nodes, 'm')})"
    return f"if({want}.path, {_xpath_texts_sql(nodes, hits, want)}, filter({records}, r -> r <> ''))"


def items_sql(nodes: str, tree: str) -> str:
    """Per selector of a tree struct(selector, supported, items): the item strings it yields on one page."""
    found = (f"transform(tree.wanted, want -> struct(want.selector as selector, want.supported as supported, "
             f"{_items_of_sql('page', 'hits', 'want')} as items))")
    return bind(nodes, "page", bind(tree, "tree", bind(hits_sql("page", "tree.levels"), "hits", found)))


def first_items_sql(nodes: str, tree: str) -> str:
    """struct(selector, items) of the first selector of a tree that yields anything; of none: nulls and no items."""
    none = "struct(cast(null as string) as selector, cast(array() as array<string>) as items)"
    step = f"if(size(acc.items) > 0, acc, struct(want.selector as selector, {_items_of_sql('page', 'hits', 'want')} as items))"
    return bind(nodes, "page", bind(tree, "tree", bind(
        hits_sql("page", "tree.levels"), "hits", f"aggregate(tree.wanted, {none}, (acc, want) -> {step})")))


def element_records(parsed: DataFrame, selector: str, key: str = "page_id") -> DataFrame:
    """One row per item of a literal selector: key, pos, item."""
    items = items_sql("nodes", literal_tree_sql(selector))
    return parsed.select(key, F.expr(f"posexplode(get({items}, 0).items)").alias("pos", "item"))


def selector_items(pages: DataFrame, selectors: DataFrame, on: str = "page_id", html: str = "html",
                   cleaned: bool = True) -> DataFrame:
    """All items of a page under each of its selectors, as one row per page and selector: the other
    columns of ``pages``, selector, items (empty when nothing matches).

    Selectors are tried on the cleaned page (see ``clean_pages``), so menus and footers never match;
    ``cleaned=False`` tries them on the page as it is. The selectors of a key are joined as one tree
    (``tree_sql``, built once for the key) before parsing: a join that has to shuffle moves the HTML, not the larger node arrays, and each
    page is parsed and cleaned once for about SELECTORS_A_PARSE of them. Small selector tables are
    broadcast by the planner, which checks their size. ``supported`` is false for a selector outside
    the subset, which has no items.
    """
    wanted = selectors.select(on, "selector").where(F.col("selector").isNotNull()).distinct()
    parts = wanted.groupBy(on).agg(F.ceil(F.count(F.lit(1)) / SELECTORS_A_PARSE).alias("_parts"))
    grouped = (
        wanted.join(parts, on).groupBy(on, F.expr("pmod(xxhash64(selector), _parts)").alias("_part"))
        .agg(F.array_sort(F.collect_list("selector")).alias("_selectors"))
        .select(on, F.expr(tree_sql("_selectors")).alias("_tree")))
    parsed = parse_pages(pages.join(grouped, on), html)
    key = [c for c in parsed.columns if c not in ("nodes", "_tree")]
    found = bind(clean_sql("nodes") if cleaned else "nodes", "tried", items_sql("tried", "_tree"))
    return parsed.select(*key, F.expr(f"inline({found})"))


def apply_selectors(pages: DataFrame, selectors: DataFrame, on: str = "page_id", html: str = "html",
                    cleaned: bool = True) -> DataFrame:
    """Items of every page under its own selectors; ``selectors(on, selector)`` may hold several
    per key. One row per item: the other columns of ``pages``, selector, supported, pos, item. A selector
    outside the subset gives one row with ``supported`` false and no item, so that it is not lost."""
    found = selector_items(pages, selectors, on, html, cleaned)
    key = [c for c in found.columns if c != "items"]
    every = found.select(*key, F.posexplode_outer("items").alias("pos", "item"))
    return every.where(F.col("pos").isNotNull() | ~F.col("supported"))


def sample_items(items: DataFrame, k: int, seed: int = 0, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """At most ``k`` items per key, chosen by a seeded hash; all of them when there are fewer.

    ``row_number() <= k`` lets Spark keep the best ``k`` of every partition before the shuffle.
    """
    order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col("item"))), F.col("pos")]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return items.withColumn("sample_no", place).where(F.col("sample_no") <= k)

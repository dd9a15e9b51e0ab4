"""Selectors as trees of steps, held against a plain matcher."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pageloom.operators import extract, fetch, select
from pageloom.operators.html import parse_pages

STEPS = ["div:nth-child(1)", "ul:last-child", ":nth-child(2)", "div.b:nth-last-child(3)", ".a:nth-child(1):last-child", "div", "ul", "li", ".a", "div.b", "li.a.b", "#x", "[t]", 'li[t="1"]', "*"]


def plain_match(nodes, selector):
    """Places of matching elements: every alternative, every ancestor tried."""
    def place(n, text):
        kin = [m.pre for m in nodes if m.parent == n.parent and not m.tag.startswith("#")]
        at = kin.index(n.pre)
        return all((len(kin) - 1 - at if last else at) + 1 == int(k or 1) for last, k in re.findall(r":(?:nth)?(?:-?(last))?-child(?:\((\d+)\))?", text))

    def simple(n, text):
        if n.tag.startswith("#"):
            return False
        if not place(n, text):
            return False
        text = re.sub(r":[a-z-]+(\(\d+\))?", "", text)
        parts = re.match(r"^(\*|[a-z0-9]*)((?:[.#][a-z]+)*)(?:\[t(?:=\"(\d)\")?\])?$", text)
        words = (n.attrs.get("class") or "").split()
        marks = re.findall(r"[.#][a-z]+", parts[2])
        return ((parts[1] in ("", "*", n.tag)) and all(m[1:] in words if m[0] == "." else n.attrs.get("id") == m[1:] for m in marks)
                and ("[" not in text or ("t" in n.attrs and (parts[3] is None or n.attrs["t"] == parts[3]))))

    def holds(n, steps):
        if not simple(n, steps[-1]):
            return False
        if len(steps) == 1:
            return True
        up, near = n.parent, steps[-2] == ">"
        rest = steps[:-2] if near else steps[:-1]
        while up >= 0:
            if holds(nodes[up], rest):
                return True
            if near:
                return False
            up = nodes[up].parent
        return False
    return [n.pre for n in nodes if any(holds(n, alt.split()) for alt in selector.split(","))]


def random_pages(n, rng):
    def element(depth):
        tag = rng.choice(["div", "ul", "li"])
        attrs = rng.choice(["", ' class="a"', ' class="b a"', ' class="b"', ' id="x"', ' t="1"', ' t="2" class="a b"'])
        inner = "".join(element(depth - 1) for _ in range(rng.randint(0, 3))) if depth else "x"
        return f"<div{attrs}>{inner}</div>" if tag == "div" else f"<ul{attrs}><li{attrs}>{inner}</li></ul>"
    return [(i, "".join(element(4) for _ in range(3))) for i in range(n)]


def random_selector(rng):
    def steps():
        return rng.choice([" ", " > "]).join(rng.choice(STEPS) for _ in range(rng.randint(1, 3)))
    return ", ".join(steps() for _ in range(rng.choice([1, 1, 2])))


def test_trees_match_like_a_plain_matcher(spark):
    rng = random.Random(3)
    pages = spark.createDataFrame(random_pages(12, rng), "page_id int, html string")
    parsed = parse_pages(pages).cache()
    held = {r.page_id: r.nodes for r in parsed.collect()}
    chosen = sorted({random_selector(rng) for _ in range(120)})
    counts = f"inline(transform({select.css_sql('nodes', select.literal_tree_sql(*chosen))}, f -> struct(f.selector as selector, transform(f.found, n -> n.pre) as pres)))"
    got = {(r.page_id, r.selector): r.pres for r in parsed.select("page_id", F.expr(counts)).collect()}
    assert len(got) == len(held) * len(chosen) and any(got.values())
    for (page, selector), pres in got.items():
        assert pres == plain_match(held[page], selector), (page, selector)
    # the same selectors as data: one tree for each of several parts of about 64
    wanted = spark.createDataFrame([(i, s) for i in held for s in chosen], "page_id int, selector string")
    rows = select.selector_items(pages, wanted, cleaned=False).select("page_id", "selector", "supported").collect()
    assert sorted((r.page_id, r.selector) for r in rows) == sorted(got) and all(r.supported for r in rows)
    parsed.unpersist()


def test_places_leave_out_texts_and_what_was_cleaned(spark):
    pages = spark.createDataFrame([(1, "<div>t<nav>m</nav><p>a</p>u<p>b</p><!-- c --><p>c</p></div>"), (2, "<p>only"), (3, "")], "page_id int, html string")
    wanted = spark.createDataFrame([(i, s) for i in (1, 2, 3) for s in ("div > p:nth-child(1)", "p:nth-child(2)", "p:last-child", "p:nth-child(0)")], "page_id int, selector string")
    got = {(r.page_id, r.selector): (r.supported, r["items"]) for r in select.selector_items(pages, wanted).collect()}
    assert got[1, "div > p:nth-child(1)"] == (True, ["a"]) and got[1, "p:nth-child(2)"] == (True, ["b"]) and got[1, "p:last-child"] == (True, ["c"])
    assert got[2, "p:last-child"] == (True, ["only"]) and got[3, "p:last-child"] == (True, []) and not got[1, "p:nth-child(0)"][0]


def test_equal_beginnings_stand_once(spark):
    df = spark.createDataFrame([(["ul > li a", "ul > li b, ul li", "xpath://ul/li/@href", "a:hover", "xpath://text()", "ul > li a"],), ([],), (None,)], "s array<string>")
    trees = [r.tree for r in df.select(F.expr(select.tree_sql("s")).alias("tree")).collect()]
    levels, wanted = trees[0].levels, trees[0].wanted
    assert [len(level) for level in levels] == [1, 2, 2]
    assert [(n.parent, n.open, n.step.tag) for level in levels for n in level] == [
        (-1, True, "ul"), (0, True, "li"), (0, False, "li"), (1, False, "a"), (1, False, "b")]
    assert [list(w.ends) for w in wanted] == [[3], [4, 2], [1], [], [], [3]]
    assert [w.supported for w in wanted] == [True, True, True, False, True, True]
    assert (trees[1].levels, trees[1].wanted) == ([], []) and trees[2].wanted is None


def test_unsupported_and_missing_selectors(spark):
    pages = spark.createDataFrame([(1, "<ul><li>a<li>b</ul>", "li"), (2, None, "li"), (3, "<p>x", "p:hover"), (4, "", None), (5, "<p>y", "xpath:")], "page_id int, html string, selector string")
    got = {(r.page_id, r.pos): (r.supported, r.item) for r in select.apply_selectors(pages.drop("selector"), pages.select("page_id", "selector")).collect()}
    assert got == {(1, 0): (True, "a"), (1, 1): (True, "b"), (3, None): (False, None), (5, None): (False, None)}
    for bad in ("p:hover", "", "xpath:", "xpath:p[", "a >"):
        with pytest.raises(ValueError):
            select.literal_tree_sql(bad)


def test_pages_see_no_selector_text(spark, tmp_path):
    """What stands above the parse has no pattern of the selector grammar; literals are constants."""
    spark.createDataFrame([(1, "https://a.test/", "<p>x")], "page_id int, url string, html string").write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    wanted = spark.createDataFrame([(1, "p"), (1, "p > b")], "page_id int, selector string")
    for df in (select.apply_selectors(pages, wanted), extract.extract(pages.withColumn("selector", F.lit("p"))),
               fetch.next_page_links(parse_pages(pages)), select.select_css(parse_pages(pages), "p > b"), select.select_xpath(parse_pages(pages), "//p")):
        text = df._jdf.queryExecution().executedPlan().toString()
        above = text[:text.index("MapInArrow")]
        assert "regexp_extract_all" not in above and " RLIKE " not in above.upper()

import random
import time

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pageloom.operators import chunks, clean, html, links, select


def texts(df):
    return [r[0] for r in df.orderBy("page_id").select(df.columns[-1]).collect()]


def test_cleaning(parse):
    d = parse("<html><body><script>alert('xss')</script><p>Hello world</p><style>.hide{display:none}</style></body></html>",
              "<html><body><script>bad()</script><p>Good</p></body></html>",
              '<div class="my-consent"><p>no</p></div><p>yes</p>', '<p style="x" id="a" data-k="v" onclick="z">t</p>')
    assert texts(clean.page_text(d))[:2] == ["Hello world", "Good"]
    out = texts(clean.render_html(clean.clean_pages(d)))
    assert out == ["<body><p>Hello world</p></body>", "<body><p>Good</p></body>", "<body><p>yes</p></body>",
                   '<body><p id="a" data-k="v">t</p></body>']


def test_tree_rules(parse):
    d = parse("<ul><li>a<li>b<ul><li>c</ul></ul>", "<table><tr><td>a<td>b<tr><td>c</table>", "<p>a<div>b</div>c", "a &amp &lt;b&gt; <br> <img src=x>",
              "<title>T</title><p>x", "", "<!-- c --><p>x</p><script>var a='</p>'</script>", "<b>x<p>y")
    assert texts(clean.render_html(d)) == [
        "<html><body><ul><li>a</li><li>b<ul><li>c</li></ul></li></ul></body></html>",
        "<html><body><table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table></body></html>",
        "<html><body><p>a</p><div>b</div>c</body></html>",
        '<html><body>a &amp; &lt;b&gt; <br/> <img src="x"/></body></html>',
        "<html><head><title>T</title></head><body><p>x</p></body></html>", "",
        "<!-- c --><html><body><p>x</p><script>var a='</p>'</script></body></html>", "<html><body><b>x<p>y</p></b></body></html>"]
    assert texts(clean.page_text(d))[4] == "x"


TAGS = ["p", "div", "li", "ul", "b", "a", "td", "tr", "table", "br", "script", "head", "body", "span"]
SOUP = st.lists(st.one_of(
    st.sampled_from([f"<{t}>" for t in TAGS] + [f"</{t}>" for t in TAGS]), st.text("ab <>&\"'=", max_size=6),
    st.just('<a href="/x" class="k l">'), st.just("<!-- c -->"), st.just("<p title='")), max_size=40).map("".join)


@given(st.lists(SOUP, min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_numbering_invariants(documents):
    for nodes in html._node_list(documents).to_pylist():
        for i, n in enumerate(nodes):
            assert n["pre"] == i and i <= n["last"] < len(nodes)
            above, at = [], n["parent"]
            while at >= 0:
                above.append(at)
                at = nodes[at]["parent"]
            assert n["parent"] < i and n["depth"] == len(above)
            for a in above:
                assert a < i <= n["last"] <= nodes[a]["last"] and not nodes[a]["tag"].startswith("#")
            outside = [d for d in nodes[n["last"] + 1:] if d["parent"] == i]
            assert not outside and all(d["depth"] > n["depth"] for d in nodes[i + 1:n["last"] + 1])


def test_deep_nesting_is_kept_and_parsed_in_linear_time(parse):
    for start in ("", "<p><button>"):
        before = time.perf_counter()
        nodes = html._node_list([start + "<div>" * 20_000 + "x"])
        assert time.perf_counter() - before < 1
        assert nodes[0][-1]["depth"].as_py() == len(nodes[0]) - 1
    d = parse("<nav>" + "<div>" * 3000 + "y" + "</div>" * 3000 + "</nav>" + "<div>" * 3000 + "x")
    assert texts(clean.page_text(d)) == ["x"]
    whole = parse("<div>" * 3000 + "x")
    assert whole.select(F.array_max(F.transform("nodes", lambda n: n["depth"]))).first()[0] == 3002
    assert clean.render_html(clean.clean_pages(whole)).first().html == "<body>" + "<div>" * 3000 + "x" + "</div>" * 3000 + "</body>"
    assert select.select_css(whole, "body div").count() == 3000


def test_flags_reach_all_below(spark):
    rng = random.Random(3)
    for size in (0, 1, 2, 40, 300):
        parents = [rng.choice([i - 1, rng.randrange(-1, i)]) for i in range(size)]
        flags = [rng.random() < 0.05 for _ in range(size)]
        depth, want = [], []
        for i, p in enumerate(parents):
            depth.append(depth[p] + 1 if p >= 0 else 0)
            want.append(flags[i] or (p >= 0 and want[p]))
        rows = spark.createDataFrame([([(i, p, d) for i, (p, d) in enumerate(zip(parents, depth))], flags)],
                                     "ns array<struct<pre: int, parent: int, depth: int>>, flags array<boolean>")
        assert rows.select(F.expr(html.inside_sql("ns", "flags"))).first()[0] == want


def test_links(parse):
    d = parse('<a href="/page1">Page 1</a><a href="https://other.com/page2">External</a><a href="#section">F</a><a href="javascript:void(0)">J</a>',
              '<a href="/about">About</a><a href="/about">About again</a><a href="/about#team">Team</a><a href=" tel:1 ">c<b> d </b></a><a href="mailto:x">m</a><a>n</a><a href="">e</a>')
    rows = [tuple(r) for r in links.extract_links(d).orderBy("page_id", "pos").collect()]
    assert rows == [(0, 0, "Page 1", "https://example.com/page1"), (0, 1, "External", "https://other.com/page2"),
                    (1, 0, "About", "https://example.com/about"), (1, 3, "cd", "tel:1")]


def test_main_text(parse):
    d = parse("<nav><p>menu menu menu menu menu menu</p></nav><h1>Title</h1><p>A long enough paragraph of text.</p><p><a href=x>only a long link inside here</a></p><p>short</p><table><tr><td>cell</table>",
              "<div>loose words</div>")
    assert texts(clean.main_text(d)) == ["Title\nA long enough paragraph of text.\nshort\ncell", "loose words"]
    card = parse("<ul><li><a href=x>only a link</a><li><a href=y>Book</a> 5 EUR</ul><a href=z><p>name</p></a>")
    assert texts(clean.main_text(card)) == ["Book 5 EUR\nname"]


def test_main_text_by_density(parse):
    story = [f"Sentence number {i} of a story that somebody wrote into plain containers." for i in range(6)]
    notice = "<div>Cookies are used here.</div>"
    menu = "<div>" + "".join(f"<a href=/{i}>A link of the long menu {i}</a> " for i in range(9)) + "</div>"
    d = parse(
        f"{notice}{menu}<h1>Title</h1><div>{'</div><div>'.join(story)}</div>{menu}<div>Imprint</div>",  # an article in divs
        f"<h1>Title</h1><div>{story[0]}{story[1]}<br>{story[2]}</div>",  # one div beside a heading
        f"{notice}<p>One paragraph.</p>",  # a lone notice is no prose
        "<ul><li>loose<p>x</p>tail</li></ul>",  # text beside a block inside a block
        "<div>before <b>bold</b><p>inner</p></div>" + "<p>" + "words " * 40 + "</p>",
        f"<table><tr><td><div>{story[0]}</div><div>b</div></td></tr></table><p><a href=x>{story[1]}</a></p>",
        "", "<div></div>", f"<p>{story[0]}</p><div>bridge</div><p>{story[1]}</p>",
        "<p>x" + "<b><div>" * 3000 + "deep" + "</div></b>" * 3000)
    got = texts(clean.main_text(d))
    assert got[0] == "\n".join(["Title", *story])
    assert got[1] == f"Title\n{story[0]}{story[1]} {story[2]}"
    assert got[2:4] == ["One paragraph.", "loose\nx\ntail"]
    assert got[4] == ("words " * 40).strip().join(["inner\n", ""])
    assert got[5] == f"{story[0]} b"
    assert got[6:8] == ["", ""]
    assert got[8] == f"{story[0]}\n{story[1]}"
    assert got[9] == "x"


def test_chunks_of_a_deep_page(parse):
    deep = clean.clean_pages(parse("<div>" * 20_000 + "the text" + "</div>" * 20_000))
    rows = chunks.chunk_pages(deep).collect()
    assert "".join(r.html for r in rows).count("the text") == 1 and max(r.n_chars for r in rows) <= 6000


def test_running_sums_and_nearest(spark):
    rows = spark.createDataFrame([([3, 1, 4, 1, 5, 9, 2],), ([],), ([7],)], "v array<int>")
    assert [r[0] for r in rows.select(F.expr(html.running_sum_sql("v"))).collect()] == [[3, 4, 8, 9, 14, 23, 25], [], [7]]


def element(tag, size):
    return f"<{tag}>" + "x" * (size - 2 * len(tag) - 5) + f"</{tag}>"


def test_chunk_fixtures(parse):
    d = clean.clean_pages(parse(
        "<body>" + "<div><p>Item</p></div>" * 50 + "</body>", "",
        "<body>" + element("p", 2000) + "<div>" + element("p", 4000) + element("p", 2989) + "</div>" + element("p", 1000) + "</body>"))
    rows = chunks.chunk_pages(d).orderBy("page_id", "chunk_no").select("page_id", "n_chars").collect()
    assert [tuple(r) for r in rows] == [(0, 1149), (1, 0), (2, 2000), (2, 4000), (2, 2989), (2, 1000)]
    kept = chunks.chunk_pages(clean.clean_pages(parse("<p>a</p>" + element("div", 70) + "<p>b</p>")), 20)
    assert [r[0] for r in kept.orderBy("chunk_no").select("html").collect()] == ["<p>a</p>", "x" * 20, "x" * 20, "x" * 19, "<p>b</p>"]


def brute_chunks(tree, limit):
    """The rule on nested (markup size, children) trees: sizes of the members of every chunk."""
    out = []

    def walk(children):
        current = []
        for child in children:
            if child[0] > limit:
                if current:
                    out.append(current)
                    current = []
                if child[1] is None:
                    out.extend([min(limit, child[0] - at)] for at in range(0, child[0], limit))
                else:
                    walk(child[1])
            else:
                if current and sum(current) + child[0] > limit:
                    out.append(current)
                    current = []
                current.append(child[0])
        if current:
            out.append(current)

    walk(tree)
    return out


def random_tree(rng, depth):
    """Markup and (size, children) of a random div."""
    kids = [random_tree(rng, depth - 1) for _ in range(rng.randint(0, 4))] if depth else []
    loose = "x" * rng.choice([0, rng.randint(0, 30), rng.randint(0, 200)])
    markup = f"<div>{loose}{''.join(k[0] for k in kids)}</div>"
    return markup, (len(markup), [(len(loose), None)] * bool(loose) + [k[1] for k in kids])


def test_chunks_equal_brute_force(parse):
    rng = random.Random(5)
    forests = [[random_tree(rng, 4) for _ in range(rng.randint(1, 5))] for _ in range(60)]
    d = clean.clean_pages(parse(*["<body>" + "".join(m for m, _ in f) + "</body>" for f in forests]))
    rows = chunks.chunk_pages(d, 90).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("chunk_no", "n_chars"))).alias("c")).collect()
    got = {r.page_id: [c.n_chars for c in r.c] for r in rows}
    for i, forest in enumerate(forests):
        want = [sum(c) + len(c) - 1 for c in brute_chunks([t for _, t in forest], 90)]
        if want:
            assert got[i] == want


PAGE = """<div class="a b" id=x><ul><li><a href="/1"><h3>T</h3>more</a><li class=z><a href="/2" aria-label="Next Page">two</a>
<a href="/3"></a></ul><p>q<b>r</b> s</p></div><p class="z" lang="en-GB">last</p><div data-href="/d">line one
line two</div>"""


@pytest.mark.parametrize("selector, want", [
    ("li a", ["name: T\nurl: /1", "name: two\nurl: /2", "url: /3"]), ("div.b > ul > li", ["T\nmore", "two"]),
    ("#x p, p.z", ["q\nr\ns", "last"]), ('a[aria-label="Next Page"]', ["name: two\nurl: /2"]), ("div > a", []),
    ("a[href^='/'][href$='3']", ["url: /3"]), ("p.a", []), (".z", ["two", "last"]), ("P", ["q\nr\ns", "last"]),
    ("[lang|=en]", ["last"]), ("div[class~=b] p", ["q\nr\ns"]), ("[data-href]", ["name: line one\nurl: /d"]),
    ("xpath://p", ["qr s", "last"]), ("xpath://li/a/@href", ["/1", "/2", "/3"]), ("xpath://p/text()", ["q", "s", "last"]),
    ("xpath:/html/body/p", ["last"]), ("xpath://div[@id='x']//b", ["r"]), ("xpath://div[contains(@class,'b')]/p", ["qr s"]),
    ("xpath://*[@lang]", ["last"]),
])
def test_selectors(parse, selector, want):
    rows = select.element_records(parse(PAGE), selector).orderBy("pos").collect()
    assert [r.item for r in rows] == want


def test_unsupported_selectors(spark, parse):
    for bad in ("p:first-child", "a + b", "xpath://p[1]", "", "a >", "xpath:"):
        with pytest.raises(ValueError):
            select.element_records(parse(PAGE), bad)
    pages = spark.createDataFrame([(1, "<p>x</p>")], "page_id int, html string")
    chosen = spark.createDataFrame([(1, "p:first-child"), (1, "p"), (1, "xpath://p[1]")], "page_id int, selector string")
    rows = sorted((r.selector, r.supported, r.pos, r.item) for r in select.apply_selectors(pages, chosen).collect())
    assert rows == [("p", True, 0, "x"), ("p:first-child", False, None, None), ("xpath://p[1]", False, None, None)]


def test_many_selectors_of_a_key(spark):
    pages = spark.createDataFrame([(1, "h", "<p class='c7 c150'>x</p>")], "page_id int, host string, html string")
    chosen = spark.createDataFrame([("h", f"p.c{i}") for i in range(300)] * 2 + [("h", None)], "host string, selector string")
    found = select.apply_selectors(pages, chosen, on="host")
    assert sorted(r.selector for r in found.collect()) == ["p.c150", "p.c7"]


def test_sample(spark):
    items = spark.range(100).selectExpr("id % 3 as page_id", "id as pos", "cast(id as string) as item")
    a = select.sample_items(items, 5, seed=1)
    assert a.count() == 15 and sorted(a.collect()) == sorted(select.sample_items(items.repartition(7), 5, seed=1).collect())
    assert select.sample_items(items, 5, seed=2).join(a, ["page_id", "pos"]).count() < 15


def test_many_open_elements_parse_in_linear_time():
    import time
    from pageloom.operators.html import _Nodes
    began = time.process_time()
    reader = _Nodes()
    reader.read("<div>" * 20_000 + "</i>" * 20_000)
    assert len(reader.tag) == 20_002 and time.process_time() - began < 5

from urllib.parse import urljoin

from pyspark.sql import functions as F

from pageloom.functions import requests as rules, urls
from pageloom.functions.replies import decode_response, reply_string
from pageloom.operators import intents


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_urls(spark):
    assert column(spark, ["get prices from https://shop.test/catalogue", "scrape http://example.com please",
                          "no url here", "check https://example.com.", "see 'https://a.test/x'), ok"], urls.extract_url) == [
        "https://shop.test/catalogue", "http://example.com", None, "https://example.com", "https://a.test/x"]
    assert column(spark, ["https://example.com/", "example.com", "a.test//", "example.com:8080/x"], urls.normalise_url) == [
        "https://example.com", "https://example.com", "https://a.test", "example.com:8080/x"]


def test_same_domain(spark):
    df = spark.createDataFrame([("https://example.com/page", "https://example.com"), ("https://other.com/page", "https://example.com"),
                                ("https://a.test:80/", "https://a.test/"), ("https://münchen.test/ x", "http://münchen.test")], "a string, b string")
    assert [r[0] for r in df.select(urls.same_domain(F.col("a"), F.col("b"))).collect()] == [True, False, False, True]


def test_resolve_href_equals_urljoin(spark):
    bases = ["https://example.com", "https://e.com/a/b/c", "http://e.com/a/b/?q=1", "https://e.com/a//b/c?x#f", "https://e.com/a/../b/c", "http://h.test:81/x;p/y"]
    hrefs = ["", "x", "/x", "//h/y", "?q", "../x", "../../../../x", "./x", "x/../y", "/a/./b/../c", "..", ".", "x/", "#f", "x#f",
             "https://o.com/p", "https:rel", "HTTPS://O.com/P", "tel:1", "mailto:a@b", "ftp://f/x", "/a//b", "a//b", "x?y=/../z", "?", "../", "/..", "é/ü", "a b"]
    rows = [(b, h) for b in bases for h in hrefs]
    df = spark.createDataFrame(rows, "b string, h string")
    got = [r[0] for r in df.select(urls.strip_fragment(urls.resolve_href("b", "h"))).collect()]
    wrong = [(b, h, g, urljoin(b, h)) for (b, h), g in zip(rows, got) if g != urljoin(b, h).split("#")[0]]
    assert wrong == []


def test_heuristics(spark):
    queries = ["give me all the links on https://example.com", "get product name and price from https://shop.test",
               "get the title and summary of each article on https://blog.example.com", "what is on https://example.com",
               "get me some data", "get all links from https://news.ycombinator.com"]
    df = spark.createDataFrame(list(enumerate(queries)), "request_id int, query string")
    rows = intents.heuristic_intents(df).orderBy("request_id").collect()
    assert [(r.intent_type, r.depth) for r in rows if r.error is None] == [
        ("url_list", 0), ("structured_data", 0), ("deep_content", 2), ("page_content", 0), ("url_list", 0)]
    assert rows[4].error.startswith("Could not find a URL") and rows[4].url is None


def test_hints(spark):
    url = F.lit("https://example.com")
    target = column(spark, ["get me the product name and price from https://example.com"], lambda q: rules.content_target(q, url))[0]
    assert "product name and price" in target and "get" not in target.split()
    assert column(spark, ["get names from https://e.com/data.json", "x in csv file", "plain text to a file", "nothing"],
                  lambda q: rules.output_file_hint(q, F.lit("https://a.b.test/x"))) == ["data.json", "a_b_test.csv", "a_b_test.txt", None]
    assert column(spark, ["x csv json", "as Markdown", "an md file", "as text", "data.json", "none"], rules.output_format_hint) == [
        "csv", "md", "md", "text", "json", None]
    assert column(spark, ["first 3 pages", "page through", "none"], rules.pagination_wanted) == [True, True, False]
    assert column(spark, ["first 3 pages", "1 page", "page through"], rules.pagination_pages) == [3, 1, None]


def test_decode(spark):
    raws = ['{"selector": "div.item", "xpath": null}', '```json\n{"selector": "li.product"}\n```', "not json at all", "```\n{\"selector\": 1}\n```"]
    assert column(spark, raws, lambda r: reply_string(decode_response(r), "$.selector")) == ["div.item", "li.product", None, "1"]


def test_replies_and_cascade(spark):
    queries = ["get names from https://a.test", "scrape every page of https://b.test", "links please", "links on https://d.test"]
    requests = spark.createDataFrame(list(enumerate(queries)), "request_id int, query string")
    ids = intents.build_intent_prompts(requests)
    raw = {0: '{"url": "https://a.test", "intent_type": "structured_data", "content_target": "", "paginate": "false", "max_urls": 0}',
           1: "oops", 2: '{"intent_type": "url_list"}', 3: '{"intent_type": "deep_content", "depth": 1}'}
    replies = ids.select("prompt_id", F.element_at(F.create_map(*[F.lit(x) for kv in raw.items() for x in kv]), F.col("request_id")).alias("raw"))
    parsed = {r.request_id: r for r in intents.parse_intent_response(requests, replies).collect()}
    assert (parsed[0].url, parsed[0].content_target, parsed[0].paginate, parsed[0].max_urls) == ("https://a.test", "names", False, 0)
    assert parsed[1].error and parsed[2].error and parsed[3].depth == 2
    second = ids.where("request_id = 1").select("prompt_id", F.lit('{"url": "c.test", "intent_type": "page_content", "depth": 3}').alias("raw"))
    got = {r.request_id: r for r in intents.resolve_intents(requests, replies, second).collect()}
    assert [got[i].source for i in range(4)] == ["primary", "secondary", "wording", "primary"]
    assert got[1].url == "https://c.test" and got[1].depth == 3 and got[2].error


def test_explicit(spark):
    given = spark.createDataFrame([(1, "https://example.com", None, None), (2, "https://example.com", "price", 0)], "request_id int, url string, target string, depth int")
    rows = {r.request_id: r for r in intents.explicit_intents(given).collect()}
    assert (rows[1].intent_type, rows[1].max_urls, rows[1].depth) == ("page_content", 0, 1)
    assert (rows[2].intent_type, rows[2].content_target, rows[2].depth) == ("structured_data", "price", 0)

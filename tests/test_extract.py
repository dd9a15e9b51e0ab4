import pandas as pd
import pytest
from pyspark.sql import functions as F

from pageloom.operators import chunks, clean, extract
from pageloom.operators.html import parse_pages

BOOKS = "".join(f'<article class="book"><h3>Book {n}</h3><p class="price">£{n}0.00</p></article>' for n in (1, 2, 3))


def replies(spark, rows):
    return spark.createDataFrame(rows, "page_id int, attempt int, raw string")


def test_pipeline(spark):
    pages = spark.createDataFrame([
        (1, '<article class="product_pod"><p class="price_color">£51.77</p></article><article class="product_pod"><p class="price_color">£22.00</p></article>'),
        (2, "<p>nothing</p>"), (3, BOOKS), (4, '<div class="chunk1"><p>Chunk 1</p></div><div class="chunk2"><p>Chunk 2</p></div>'),
        (5, "<p>Hello world</p>"), (6, "<p>Some content</p>")], "page_id int, html string")
    targets = spark.createDataFrame([(i, "" if i == 5 else "wanted") for i in range(1, 7)], "page_id int, content_target string")
    found = extract.selector_candidates(replies(spark, [
        (1, 1, '{"selector": "p.price_color", "xpath": null, "reasoning": "r"}'), (2, 1, '{"selector": "div.nonexistent"}'),
        (3, 1, '```json\n{"selector": "article.book"}\n```'), (4, 1, '{"selector": "div.chunk1"}'), (4, 2, '{"selector": "p"}'),
        (4, 3, "broken"), (6, 1, '{"selector": null, "xpath": null}')]))
    asked = extract.validation_prompts(found, pages, targets)
    rows = {(r.page_id, r.attempt): r for r in asked.collect()}
    assert rows[2, 1].valid is False and rows[2, 1].reason == "Selector returned 0 elements." and rows[2, 1].prompt is None
    assert "£51.77" in rows[1, 1].prompt and rows[1, 1].valid is None
    answered = asked.where("prompt is not null").select("page_id", "attempt", F.expr(
        "case when page_id = 4 and attempt = 1 then '{\"valid\": false, \"reason\": \"wrong\"}' else '{\"valid\": true, \"reason\": \"ok\"}' end").alias("raw"))
    choices = extract.choose_selector(pages, asked, extract.validation_verdicts(answered))
    assert {r.page_id: r.selector for r in choices.collect()} == {1: "p.price_color", 2: None, 3: "article.book", 4: "p", 5: None, 6: None}
    fields = extract.infer_fields(spark.createDataFrame([(3, '{"fields": ["title", "price"]}'), (4, "oops")], "page_id int, raw string"))
    results = {r.page_id: r for r in extract.extract(extract.with_choices(pages, targets, choices, fields)).collect()}
    assert results[3].method == "llm_selector" and len(results[3]["items"]) == 3 and results[3].schema_fields == ["title", "price"]
    assert results[4].selector_used == "p" and results[4].schema_fields == ["value"]
    assert results[5].method == "text_only" and results[5].cleaned_text == "Hello world" and results[5].selector_used is None
    assert results[6].method == "text_only" and results[6].schema_fields == ["content"]
    assert {r.page_id for r in extract.extract(pages).where("method = 'text_only'").collect()} == {1, 2, 3, 4, 5, 6}


def test_selection_on_cleaned_pages(spark):
    page = '<nav><a href="/n">Nav</a></nav><ul><li><a href="/a">A</a></li></ul><footer><a href="/f">F</a></footer>'
    pages = spark.createDataFrame([(1, page)], "page_id int, html string")
    targets = spark.createDataFrame([(1, "links")], "page_id int, content_target string")
    chosen = spark.createDataFrame([(1, "a")], "page_id int, selector string")
    assert extract.extract(extract.with_choices(pages, targets, chosen)).first()["items"] == ["name: A\nurl: /a"]
    # an attempt without matches is out, also when a reply calls it valid
    found = extract.selector_candidates(replies(spark, [(1, 1, '{"selector": "nav a"}'), (1, 2, '{"selector": "li a"}')]))
    tried = extract.validation_prompts(found, pages, targets)
    yes = extract.validation_verdicts(replies(spark, [(1, 1, '{"valid": true}'), (1, 2, '{"valid": true}')]))
    assert extract.choose_selector(pages, tried, yes).first().selector == "li a"


def test_prompts(spark):
    pages = parse_pages(spark.createDataFrame([(1, "<div>x</div>" * 2000), (2, "<p>y")], "page_id int, html string"))
    targets = spark.createDataFrame([(1, "wanted"), (2, "")], "page_id int, content_target string")
    prompts = extract.selector_prompts(chunks.chunk_pages(clean.clean_pages(pages)), targets, max_attempts=3)
    assert sorted((r.page_id, r.attempt) for r in prompts.collect()) == [(1, 1), (1, 2), (1, 3)]
    answers = extract.answer_prompts(prompts, lambda p: p.str.len().astype(str) if isinstance(p, pd.Series) else p)
    assert answers.count() == prompts.select("prompt_id").distinct().count()


def test_cache_and_fields(spark):
    choices = spark.createDataFrame([("https://a.test/1", "p", 1), ("https://a.test/2", "li", 2), ("https://b.test/1", None, 3)], "url string, selector string, url_seq int")
    urls = spark.createDataFrame([("https://a.test/2",), ("https://a.test/9",), ("https://b.test/1",)], "url string")
    got = {r.url: r.selector for r in extract.lookup_selector(urls, extract.selector_cache(choices)).collect()}
    assert got == {"https://a.test/2": "li", "https://a.test/9": "p", "https://b.test/1": None}
    results = spark.createDataFrame([("j", 1, ["a"]), ("j", 2, ["b"]), ("j", 3, ["value"]), ("k", 1, ["value"])], "job_id string, url_seq int, schema_fields array<string>")
    assert {r.job_id: r.fields for r in extract.job_fields(results).collect()} == {"j": ["b"], "k": ["value"]}


def test_mined_selectors(spark):
    pages = spark.createDataFrame([(1, "https://a.test/1", '<div class="b a">1</div><div class="a b">2</div><p>3'), (2, "https://a.test/2", '<div class="a b">1</div>')],
                                  "page_id int, url string, html string")
    rows = {r.selector: (r.elements, r.pages, r.most_on_page) for r in extract.mine_selectors(parse_pages(pages)).collect()}
    assert rows["div.a.b"] == (3, 2, 2) and rows["p"] == (1, 1, 1)


def test_coverage(spark):
    rows = [("j", "a", "1"), ("j", "a", ""), ("j", "b", "x"), ("k", "a", None)]
    got = {(r.job_id, r.field): (r.coverage, r.valid) for r in extract.field_coverage(spark.createDataFrame(rows, "job_id string, field string, value string")).collect()}
    assert got == {("j", "a"): (0.5, True), ("j", "b"): (1.0, True), ("k", "a"): (0.0, False)}


def test_hints_in_the_order_of_the_walk(spark):
    """Early pages have none, later ones the first selector found before them; other hosts and jobs don't mix."""
    from pageloom.operators.extract import host_hints
    from pageloom.plans.run import job_results
    rows = [("j", i, f"https://a.test/{i}") for i in range(6)] + [("j", 9, "https://b.test/x"), ("j", 10, "no address"), ("k", 0, "https://a.test/0"), ("k", 5, "https://a.test/5")]
    visits = spark.createDataFrame(rows, "job_id string, url_seq bigint, url string")
    found = spark.createDataFrame([("j", 1, None), ("j", 2, "li"), ("j", 3, "td"), ("j", 10, "x"), ("k", 5, "dd")], "job_id string, url_seq bigint, selector string")
    got = {(r.job_id, r.url_seq): r.hint for r in host_hints(visits, found).collect()}
    assert len(got) == len(rows)
    assert [got["j", i] for i in range(6)] == [None, None, None, "li", "li", "li"]
    assert not any(got[k] for k in got if k not in {("j", 3), ("j", 4), ("j", 5)})
    cache = spark.createDataFrame([("j", "https://a.test/4", 1, "own"), ("j", "https://b.test/y", 7, "later"), ("j", "https://b.test/z", 3, "first"), ("j", "u", 0, None)],
                                  "job_id string, url string, seq bigint, selector string")
    got = {(r.job_id, r.url_seq): r.hint for r in host_hints(visits, found, cache).collect()}
    assert [got["j", i] for i in range(6)] == ["own"] * 6 and got["j", 9] == "first" and got["k", 5] is None

    # a hint that matches nothing falls through to what the page finds itself, and without that to its text
    html = {0: "<p>zero</p>", 1: "<ul><li>one</ul>", 2: "<table><tr><td>two</table>", 3: "<ul><li>three</ul><table><tr><td>no</table>", 4: "<p>four</p>"}
    visited = spark.createDataFrame([("j", i, f"https://a.test/{i}", h, "deep_content", "" if i == 4 else "t") for i, h in html.items()],
                                    "job_id string, url_seq bigint, url string, html string, intent_type string, content_target string")
    own = spark.createDataFrame([("https://a.test/1", "li"), ("https://a.test/2", "td"), ("https://a.test/3", "td"), ("https://a.test/4", "p")], "url string, selector string")
    results = {r.url_seq: (r["items"], r.selector_used) for r in job_results(visited, own).collect()}
    assert results == {0: (["zero"], None), 1: (["one"], "li"), 2: (["two"], "td"), 3: (["three"], "li"), 4: (["four"], None)}


def test_a_hot_host_is_no_single_task(spark):
    from pyspark.sql import functions as F
    from pageloom.operators.extract import HOST_SALTS, host_hints
    visits = spark.range(4000).select(F.lit("j").alias("job_id"), F.col("id").alias("url_seq"), F.concat(F.lit("https://a.test/"), "id").alias("url"))
    found = visits.where("url_seq % 1000 = 7").select("job_id", "url_seq", F.concat(F.lit("s"), "url_seq").alias("selector"))
    rows = host_hints(visits, found)
    assert rows.groupBy("hint").count().orderBy("hint").collect() == [(None, 8), ("s7", 3992)]
    salts = visits.groupBy(F.pmod(F.xxhash64("url"), F.lit(HOST_SALTS))).count().collect()
    assert len(salts) == HOST_SALTS and max(r[1] for r in salts) < 400


def test_sketched_signatures_are_the_exact_ones(spark):
    """Hosts with generated names, flat counts, few or tied signatures and no address, against the plain count."""
    from pageloom.operators.extract import mine_selectors, mine_selectors_sketched, page_signatures, signature_candidates
    rows = [(i, f"https://names.test/{i}", f'<div class="card"><p class="c{i}a">x</p><p class="c{i}b">y</p></div><ul>' + "<li>z" * (i % 7)) for i in range(3000)]
    rows += [(i, f"https://flat.test/{i}", f'<b class="f{i % 500}">x</b><i class="g{i}">') for i in range(1500)]
    rows += [(i, "https://few.test/", "<p>a<p>b") for i in range(900)] + [(i, "https://tied.test/", f'<p class="t{i % 30}">') for i in range(90)]
    rows += [(i, None, "<em>x</em>") for i in range(5)] + [(9, "https://empty.test/", ""), (10, "https://null.test/", None)]
    parsed = parse_pages(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(6)).cache()
    per_page = page_signatures(parsed)
    chosen = {r.host: r for r in signature_candidates(per_page, 5, 256).collect()}
    proven = {host.split("/")[-1]: r.proven for host, r in chosen.items() if host}
    assert proven["names.test"] and not proven["flat.test"] and not proven["few.test"]
    names = next(r for host, r in chosen.items() if host and "names" in host)
    assert len(names.selectors) < 60 < per_page.where(F.col("host") == names.host).select("selector").distinct().count()
    for k, tracked in ((5, 256), (3, 4096), (8, 64)):
        exact = sorted(map(tuple, mine_selectors(parsed, k).collect()), key=repr)
        assert sorted(map(tuple, mine_selectors_sketched(parsed, k, tracked).collect()), key=repr) == exact and exact
    with pytest.raises(ValueError):
        mine_selectors_sketched(parsed, 100, 64)
    assert mine_selectors_sketched(parsed.limit(0), 5).count() == 0
    parsed.unpersist()

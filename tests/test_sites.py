import json

from pyspark.sql import functions as F

from pageloom.operators import crawl, fetch, jobs
from pageloom.operators.html import parse_pages
from pageloom.plans import run
from pageloom.sources.readers import read_jobs

WEB = {"a": "bcx", "b": "cd", "c": "ae", "d": "f", "e": "df", "f": "a"}


def address(name):
    return ("https://other.test/" if name == "x" else "https://w.test/") + name


def edges(spark):
    return spark.createDataFrame([(address(s), i, address(t)) for s, ts in WEB.items() for i, t in enumerate(ts)], "src string, pos int, href string")


def walk(spark, depth, cap, same=True, kind="deep_content"):
    intents = spark.createDataFrame([("j", address("a"), kind, cap, depth)], "job_id string, url string, intent_type string, max_urls int, depth int")
    rows = crawl.crawl(edges(spark), intents, same).collect()
    rows.sort(key=lambda r: (r.hop, r.label))
    assert [r.rank for r in rows] == ([None] * len(rows) if cap == 0 else list(range(1, len(rows) + 1)))
    return " ".join(f"{r.url[-1]}{r.hop}" for r in rows)


def test_closed_web(spark):
    assert walk(spark, 0, 25) == "a0"
    assert walk(spark, 1, 25) == "a0 b1 c1"
    assert walk(spark, 2, 25) == "a0 b1 c1 d2 e2"
    assert walk(spark, 3, 25) == "a0 b1 c1 d2 e2 f3"
    assert walk(spark, 2, 4) == "a0 b1 c1 d2"
    assert walk(spark, 2, 25, same=False) == "a0 b1 c1 x1 d2 e2"
    assert walk(spark, 3, 0) == "a0 b1 c1 d2 e2 f3"
    assert walk(spark, 3, 25, kind="structured_data") == "a0"


def _sequential(edges_of, depth, cap, steps):
    """A queue worked off page by page, stopped after some: state rows, and the whole walk's URLs."""
    queue, hops, done = [address("a")], {address("a"): 0}, 0
    state = None
    while True:
        if done == steps:
            state = [(u, hops[u], i + 1, "processed" if i < done else "pending") for i, u in enumerate(queue)]
        if done == len(queue):
            return state, queue
        url, done = queue[done], done + 1
        for target in edges_of[url]:
            if target not in hops and target.startswith("https://w.test/") and hops[url] < depth and (not cap or len(queue) < cap):
                hops[target] = hops[url] + 1
                queue.append(target)


def test_a_walk_goes_on_after_a_break_at_any_page(spark):
    of = {address(s): [address(t) for t in WEB.get(s, "")] for s in "abcdefx"}
    for cap, steps in [(25, 1), (25, 2), (5, 3), (0, 1), (0, 2), (4, 2), (25, 6)]:
        state, whole = _sequential(of, 3, cap, steps)
        rows = [("j", u, h, i, i if cap else None, s) for u, h, i, s in state] + [("j", address("zz"), 1, 0, None, "failed")]
        intents = spark.createDataFrame([("j", address("a"), "deep_content", cap, 3)], "job_id string, url string, intent_type string, max_urls int, depth int")
        stored = spark.createDataFrame(rows, "job_id string, url string, hop int, label bigint, rank int, state string")
        got = sorted((r for r in crawl.crawl(edges(spark), intents, state=stored).collect() if r.url != address("zz")), key=lambda r: (r.hop, r.label))
        assert [r.url for r in got] == whole
        assert [r.rank for r in got] == (list(range(1, len(whole) + 1)) if cap else [None] * len(whole))


def test_scope_cap(spark):
    intents = spark.createDataFrame([("j", "https://w.test/", "deep_content", 3, 1), ("free", "https://w.test/", "deep_content", 0, 1)],
                                    "job_id string, url string, intent_type string, max_urls int, depth int")
    state = spark.createDataFrame([("j", "https://w.test/p1", "pending"), ("j", "https://w.test/p2", "pending"),
                                   ("j", "https://w.test/done", "processed"), ("j", "https://w.test/bad", "failed")], "job_id string, url string, state string")
    found = [("j", u, i) for i, u in enumerate(["https://other.test/", "https://w.test/done", "https://w.test/bad", "https://w.test/n1", "https://w.test/n2", "https://w.test/bad"])]
    found += [("free", f"https://w.test/{i}", i) for i in range(50)]
    candidates = spark.createDataFrame(found, "job_id string, url string, seq int")
    kept = crawl.scope_filter(candidates, state, intents)
    assert [(r.url, r.place) for r in kept.where("job_id = 'j'").collect()] == [("https://w.test/bad", 1)]
    assert kept.where("job_id = 'free'").count() == 50
    links = candidates.withColumnRenamed("url", "href")
    enqueued = crawl.enqueue_links(links, state, intents)
    assert {r.job_id: r.added for r in crawl.added_counts(enqueued).collect()} == {"j": 1, "free": 50}


def attempts(spark, *rows):
    ranks = {"httpx": 1, "playwright": 2, "scraperapi": 3, "zyte": 4}
    return spark.createDataFrame([(u, l, ranks[l], c, h, e) for u, l, c, h, e in rows],
                                 "url string, layer string, rnk int, status_code int, html string, error string")


def test_layers(spark):
    a = attempts(
        spark, ("a", "httpx", 403, "x", None), ("a", "playwright", 404, "<p>ok", None),
        ("b", "httpx", 200, "Please enable JavaScript", None),
        ("c", "httpx", 200, "fine", None), ("c", "playwright", 200, "fine too", None),
        ("d", "httpx", 200, "Just a moment...", None), ("d", "playwright", 200, "CF-RAY: 1", None), ("d", "zyte", 503, "body", None),
        ("e", "httpx", 0, "", "timeout"), ("e", "playwright", 0, "", "not installed"))
    chosen = fetch.resolve_layer(a)
    got = {r.url: (r.layer, r.accepted, r.needs_js) for r in chosen.collect()}
    assert got == {"a": ("playwright", True, False), "b": ("httpx", False, True), "c": ("httpx", True, False),
                   "d": ("zyte", True, False), "e": ("playwright", False, False)}
    status = {r.url: (r.outcome, r.reason) for r in fetch.fetch_status(chosen).collect()}
    assert status["e"] == ("failed", "not installed") and status["b"] == ("ok", None)
    assert {r.url: r.html for r in fetch.chosen_html(a, chosen).collect()}["d"] == "body"
    forced = fetch.resolve_layer(a, browser_only=F.col("url") == "c")
    assert forced.where("url = 'c'").first().layer == "playwright"
    unknown = fetch.resolve_layer(a, browser_only=F.lit(None).cast("boolean"))
    assert sorted(unknown.collect(), key=repr) == sorted(chosen.collect(), key=repr)
    assert fetch.resolve_layer(a, layers=["httpx", "playwright"]).where("url = 'd'").first().layer == "playwright"


def test_combine_and_controls(spark):
    snaps = spark.createDataFrame([("u", 2, "<p>two"), ("u", 1, "<html><body class=x><p>one</p></body></html>"), ("u", 21, "late"), ("v", 1, "<b>only")],
                                  "url string, page_no int, html string")
    got = {r.url: r.html for r in fetch.combine_pages(snaps).collect()}
    assert got == {"u": '<html><body><body class="x"><p>one</p></body>\n<body><p>two</p></body>\n<body>late</body></body></html>', "v": "<b>only"}
    assert "late" not in {r.url: r.html for r in fetch.combine_pages(snaps, max_pages=20).collect()}["u"]
    pages = parse_pages(spark.createDataFrame([(1, '<a rel="next" href="/2">n</a><a class="next-page" href="/3">m</a>'), (2, "<p>x"),
                                               (3, '<button aria-label="Accept all cookies" id="a">ok</button>')], "page_id int, html string"))
    assert [tuple(r) for r in fetch.next_page_links(pages).collect()] == [(1, 3, "/2")]
    assert [tuple(r) for r in fetch.consent_overlays(pages).collect()] == [(3, "[aria-label='Accept all cookies']")]


def test_job_state(spark):
    state = spark.createDataFrame([("j", "u", "pending"), ("j", "v", "pending"), ("j", "w", "failed")], "job_id string, url string, state string")
    outcomes = spark.createDataFrame([("j", "u", "done"), ("j", "u", "done"), ("j", "w", "done"), ("j", "z", "failed")], "job_id string, url string, outcome string")
    after = jobs.mark_urls(state, outcomes)
    assert sorted((r.url, r.state) for r in after.collect()) == [("u", "processed"), ("v", "pending"), ("w", "failed"), ("w", "processed"), ("z", "failed")]
    again = jobs.mark_urls(after, outcomes)
    assert sorted(again.collect()) == sorted(after.collect())
    assert jobs.job_status(after).first().status == "running"
    assert jobs.job_status(after.where("state <> 'pending'")).first().status == "partial"
    assert jobs.job_status(after.where("state = 'processed'")).first().status == "complete"


def test_job_documents(spark, tmp_path):
    base = {"query": "q", "intent": {"url": "https://a.test", "content_target": "t"}, "selector_cache": {"https://a.test/1": "p"},
            "output_format": "json", "created_at": "2026-01-01", "updated_at": "2026-01-02"}
    docs = {
        "job_1": {**base, "job_id": "job_1", "status": "partial", "urls_pending": ["u2", "u1"], "urls_processed": ["u0"], "urls_failed": ["f"],
                  "results": [{"url": "u0", "items": ["x", "y"], "selector": "li", "method": "llm_selector"}]},
        "job_2": {**base, "job_id": "job_2", "status": "complete", "urls_pending": [], "urls_processed": ["v"],
                  "results": [{"url": "v", "links": [{"text": "T", "href": "/t"}]}]},
        "job_3": {**base, "job_id": "job_3", "status": "running", "urls_pending": []},
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "broken.json").write_text("{oops")
    found = read_jobs(spark, str(tmp_path))
    assert [(r.job_id, r.urls_processed, r.urls_pending) for r in jobs.list_jobs(found, 2).collect()] == [("job_3", 0, 0), ("job_2", 1, 0)]
    assert [tuple(r) for r in jobs.resumable(found).collect()] == [("job_1", "partial", 2)]
    assert [r.url for r in jobs.resume_frontier(found).orderBy("url_seq").collect()] == ["u2", "u1"]
    assert [r.item for r in jobs.saved_items(found).orderBy("pos").collect()] == ["x", "y"]
    assert [(r.text, r.href) for r in jobs.saved_links(found).collect()] == [("T", "/t")]
    assert sorted((r.url, r.selector) for r in jobs.saved_selectors(found).where("job_id = 'job_1'").collect()) == [("https://a.test/1", "p"), ("u0", "li")]
    one = jobs.inspect_job(found, "job_1").first()
    assert (one.pending, one.processed, one.failed, one.results, one.content_target) == (2, 1, 1, 1, "t")
    assert [tuple(r) for r in jobs.inspect_cache(found, "job_1").collect()] == [("https://a.test/1", "p")]


def test_whole_run(spark):
    html = {n: "".join(f'<a href="{address(t)}">{t}</a>' for t in ts) + f"<p>text of {n} that is long enough to keep</p><p>same words on every single page</p>" for n, ts in WEB.items()}
    pages = spark.createDataFrame([(i, address(n), h) for i, (n, h) in enumerate(html.items())], "page_id bigint, url string, html string")
    intents = spark.createDataFrame([("deep", address("a"), "deep_content", "paragraphs", 25, 1), ("links", address("a"), "url_list", "", 25, 1),
                                     ("free", address("b"), "deep_content", "", 0, 2)],
                                    "job_id string, url string, intent_type string, content_target string, max_urls int, depth int")
    visited = run.visited_pages(intents, pages)
    order = {}
    for r in visited.orderBy("job_id", "url_seq").collect():
        order.setdefault(r.job_id, []).append((r.url_seq, r.url[-1]))
    assert order == {"deep": [(1, "a"), (2, "b"), (3, "c")], "links": [(1, "a"), (2, "b"), (3, "c")],
                     "free": [(1, "b"), (2, "c"), (3, "d"), (4, "a"), (5, "e"), (6, "f")]}
    links = run.job_links(visited)
    assert sorted((r.url_seq, r.text) for r in links.collect()) == [(1, "b"), (1, "c"), (1, "x"), (2, "d"), (3, "a"), (3, "e")]
    choices = pages.select("url", F.lit("p").alias("selector"))
    results = run.job_results(visited, choices)
    assert {r.job_id: r.method for r in results.select("job_id", "method").distinct().collect()} == {"deep": "llm_selector", "free": "text_only"}
    found = run.job_items(results)
    deep = [r.item for r in found.where("job_id = 'deep'").orderBy("url_seq", "pos").collect()]
    assert deep == ["text of a that is long enough to keep", "same words on every single page", "text of b that is long enough to keep", "text of c that is long enough to keep"]
    saved = found.where("url_seq = 1").select("job_id", "item")
    assert run.job_items(results, saved).where("job_id = 'deep'").count() == 2


def test_resumed_run(spark):
    pages = spark.createDataFrame([(i, f"https://a.test/{i}", f"<p>item {i % 3} of the list that goes on</p>") for i in range(6)], "page_id bigint, url string, html string")
    doc = {"job_id": "j", "status": "partial", "intent": {"url": "https://a.test/0", "intent_type": "deep_content", "content_target": "items"},
           "urls_pending": ["https://a.test/4", "https://a.test/2", "https://a.test/5"], "urls_processed": ["https://a.test/0"], "urls_failed": ["https://a.test/3"],
           "results": [{"url": "https://a.test/0", "items": ["item 1 of the list that goes on"], "selector": "p", "method": "llm_selector"}]}
    jobs_ = spark.read.schema("job_id string, status string, intent struct<url string, intent_type string, content_target string>, urls_pending array<string>, "
                              "results array<struct<url string, links array<struct<text string, href string>>, items array<string>, selector string>>").json(
        spark.createDataFrame([(json.dumps(doc),)], "v string").rdd.map(lambda r: r.v))
    visited = run.resumed_pages(jobs_, pages)
    assert [(r.url_seq, r.page_id) for r in visited.orderBy("url_seq").collect()] == [(1, 4), (2, 2), (3, 5)]
    results = run.job_results(visited, pages.select("url", F.lit("p").alias("selector")))
    rows = run.resumed_items(results, jobs_).orderBy("url_seq").collect()
    assert [(r.url_seq, r.item[:6]) for r in rows] == [(0, "item 1"), (2, "item 2")]


def test_resumed_run_goes_on_crawling(spark):
    pages = spark.createDataFrame([(i, f"https://a.test/{i}", "<p>x") for i in range(9)], "page_id bigint, url string, html string")
    links = spark.createDataFrame([(f"https://a.test/{s}", i, f"https://a.test/{t}") for s, ts in {4: [0, 3, 6, 2], 2: [7, 8], 6: [1]}.items() for i, t in enumerate(ts)],
                                  "src string, pos int, href string")
    for cap, want in [(0, [4, 2, 6, 7, 8]), (5, [4, 2, 6, 7]), (25, [4, 2, 6, 7, 8])]:
        doc = {"job_id": "j", "status": "partial", "urls_pending": ["https://a.test/4", "https://a.test/2"], "urls_processed": ["https://a.test/0"],
               "urls_failed": ["https://a.test/3"], "results": [{"url": "https://a.test/0", "items": ["x"]}],
               "intent": {"url": "https://a.test/0", "intent_type": "deep_content", "content_target": "", "max_urls": cap, "depth": 1}}
        docs = spark.read.schema("job_id string, status string, intent struct<url string, intent_type string, content_target string, max_urls int, depth int>, urls_pending array<string>, "
                                 "urls_processed array<string>, urls_failed array<string>, results array<struct<url string, items array<string>>>").json(
            spark.createDataFrame([(json.dumps(doc),)], "v string").rdd.map(lambda r: r.v))
        seen = run.resumed_pages(docs, pages, links).orderBy("url_seq").collect()
        assert [(r.url_seq, r.page_id) for r in seen] == list(enumerate(want, 1))

"""Repeated stretches of a host's pages against a plain count, on pages that mark a main part and on pages that don't."""

import math
import random
from collections import defaultdict

from pageloom.llm.main_text import main_text

NOTICE = "this notice stands word for word on many pages of the host and is long"


def _texts(spark, rows):
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id bigint, url string, html string")
    return [r["text"] for r in sorted(main_text(pages).collect(), key=lambda r: r["page_id"])]


def _plain(texts, size=8):
    """Each page's words without those in runs of ``size`` that a quarter of the distinct pages, two at least, have."""
    words = {t: t.split() for t in texts}
    on = defaultdict(set)
    for t, w in words.items():
        for j in range(len(w) - size + 1):
            on[tuple(w[j:j + size])].add(t)
    needed, out = max(2, math.ceil(len(words) / 4)), []
    for t in texts:
        w = words[t]
        gone = {k for j in range(len(w) - size + 1) if len(on[tuple(w[j:j + size])]) >= needed for k in range(j, j + size)}
        out.append(" ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_stretches_against_a_plain_count(spark):
    rnd = random.Random(3)
    shared = [" ".join(f"s{k}x{j}" for j in range(9 + k)) for k in range(6)]
    rows = []
    for i in range(900):  # more tokens than one suffix array holds
        own = [" ".join(f"w{rnd.randrange(4000)}" for _ in range(12)) for _ in range(3)]
        told = [own[0]]
        for k, text in enumerate(shared):  # on nearly all pages down to a handful of them
            if rnd.random() < (0.95, 0.6, 0.3, 0.2, 0.05, 0.01)[k]:
                told += [text, own[1]]
        rows.append((f"http://big.example/{i}", f"<div>{' '.join([*told, own[2]])}</div>"))
    want = _plain([h[5:-6] for _, h in rows])
    assert _texts(spark, rows) == want
    assert any("s3x0" in t for t in want) and not any("s2x0" in t for t in want)


def test_a_run_on_two_pages_of_many_stays(spark):
    quote = "eight words that two of all these pages quote"
    rows = [(f"http://q.example/{i}", f"<div>{NOTICE}</div><p>page {i} " + (quote if i < 2 else "says no more") + "</p>") for i in range(12)]
    assert _texts(spark, rows) == [f"page {i} " + (quote if i < 2 else "says no more") for i in range(12)]


def test_copies_at_other_addresses_are_one_page(spark):
    text = "an article of more than eight words that stands at several addresses of a host"
    rows = [(f"http://c.example/{i}", f"<nav>you are at {i}</nav><p>{text}</p>") for i in range(4)]
    assert _texts(spark, rows) == [text] * 4


def test_pages_without_a_host_are_not_compared(spark):
    rows = [(u, f"<p>{NOTICE}</p><p>{i}</p>") for i, u in enumerate([None, None, "", "no address", "file:///x"])]
    assert _texts(spark, rows) == [f"{NOTICE} {i}" for i in range(5)]


def _repeated(spark, rows):
    """text and n_repeated of each page, in order."""
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id bigint, url string, html string").repartition(3)
    return [(r["text"], r["n_repeated"]) for r in sorted(main_text(pages).collect(), key=lambda r: r["page_id"])]


def test_articles_meet_the_arrays_and_stay_whole(spark):
    rnd = random.Random(4)
    shared = [" ".join(f"s{k}x{j}" for j in range(9 + k)) for k in range(4)]
    texts = []
    for _ in range(900):  # over several suffix arrays
        told = []
        for k, text in enumerate(shared):  # on most pages, around the quarter, and on few
            told += [" ".join(f"w{rnd.randrange(4000)}" for _ in range(15))] + [text] * (rnd.random() < (0.7, 0.27, 0.23, 0.02)[k])
        texts.append(" ".join(told))
    got = _repeated(spark, [(f"http://big.example/{i}", f"<nav>menu {i}</nav><article><p>{t}</p></article>") for i, t in enumerate(texts)])
    assert [t for t, _ in got] == texts
    want = [len(t.split()) - len(left.split()) for t, left in zip(texts, _plain(texts))]
    assert [n for _, n in got] == want and 0 < sum(n > 0 for n in want) < 900


def test_long_articles_meet_the_arrays(spark):
    # each is more than one suffix array should hold; shared with a quarter of the pages, and with one less
    long = [" ".join(f"p{i}w{j}" for j in range(17_000)) for i in range(8)]
    often, rare = (" ".join(f"{x}{j}" for j in range(9)) for x in ("o", "r"))
    texts = [f"{long[i]} {often if i < 2 else ''} {rare if i == 5 else ''}".strip() for i in range(8)]
    texts = [" ".join(t.split()) for t in texts]
    got = _repeated(spark, [(f"http://long.example/{i}", f"<article><p>{t}</p></article>") for i, t in enumerate(texts)])
    assert got == [(t, 9 if i < 2 else 0) for i, t in enumerate(texts)]


def test_shards_of_few_pages_give_the_same(spark, monkeypatch):
    from pageloom.llm import main_text as module
    rnd = random.Random(6)
    shared = [" ".join(f"s{k}x{j}" for j in range(rnd.randrange(6, 20))) for k in range(8)]
    rows = []
    for i in range(60):
        parts = [f"<{tag}><p>own {i} {' '.join(f'w{rnd.randrange(500)}' for _ in range(9))}</p>" + "".join(
            f"<p>{text}</p>" for k, text in enumerate(shared) if rnd.random() < 0.1 * k) + f"</{tag}>"
            for tag in rnd.sample(["nav", "article", "div"], 2)]
        rows += [(f"http://{rnd.choice('aaab')}.example/{i}{copy}", "".join(parts)) for copy in range(rnd.choice((1, 1, 2)))]
    want = _repeated(spark, rows)
    assert any(n for _, n in want)
    for name, value in (("SHARD_TOKENS", 100), ("SHARD_PAGES", 3), ("LONG_TOKENS", 120)):
        monkeypatch.setattr(module, name, value)
        assert _repeated(spark, rows) == want


def test_what_repeats_in_articles_only_stays_in_open_blocks(spark):
    text = "a passage of more than eight words which other pages have in their article"
    rows = [("http://o.example/0", f"<div>{text} 0</div>")] + [
        (f"http://o.example/{i}", f"<nav>{NOTICE}</nav><article><p>{text} {i}</p></article>") for i in (1, 2, 3)]
    assert _repeated(spark, rows) == [(f"{text} {i}", len(text.split())) for i in range(4)]


def test_kept_tokens_are_told_in_the_order_of_their_blocks(spark):
    links = "<a href=x>" + NOTICE + "</a>"
    rows = [(f"http://l.example/{i}", f"<nav>{NOTICE}</nav><article><p>own words {i}</p><div>{links}</div><p>more words {i} " + (
        NOTICE if i == 0 else "") + "</p></article>") for i in range(3)]
    size = len(NOTICE.split())
    # the list of links leaves, the same words in article text stay and are counted
    assert _repeated(spark, rows) == [(f"own words 0 more words 0 {NOTICE}", 2 * size)] + [(f"own words {i} more words {i}", size) for i in (1, 2)]


def test_no_pages_and_pages_without_text(spark):
    assert _repeated(spark, []) == []
    assert _repeated(spark, [(None, None), ("http://e.example/", None), ("http://e.example/", "")]) == [("", 0)] * 3


def _text(page):
    from pageloom.llm.main_text import page_blocks
    return [t for t, zone, _ in page_blocks(page)[0] if zone == "main"]


def test_an_article_stays_whatever_its_classes_say():
    assert _text('<main class="content has-sidebar"><p>real text</p></main>') == ["real text"]
    assert _text('<article class="post comments-open widget"><p>real text</p><div class="ad-free">more</div></article>') == ["real text", "more"]
    assert _text('<div role="main" class="search"><p>kept</p></div>') == ["kept"]
    # what is named so inside, comments written as articles, and hidden parts go as before
    assert _text('<main><p>a</p><div class="post-comments-list">b</div><article class="comment">c</article><div class="sidebar">d</div></main>') == ["a"]
    assert _text('<article hidden><p>a</p></article>') == []


def test_pages_of_unclosed_tags_take_linear_time():
    import time
    from pageloom.llm.main_text import page_blocks
    for page in ("<a " * 350_000, "<a " * 350_000 + "<!-- x", "<p>" * 300_000, '<a ">' * 200_000, "<b" * 400_000 + ">"):
        start = time.perf_counter()
        page_blocks(page)
        assert time.perf_counter() - start < 5, page[:20]
    assert page_blocks("<p>a<b")[0] == [("a<b", "open", 0.0)] and page_blocks("x <!-- y")[0] == [("x", "open", 0.0)]

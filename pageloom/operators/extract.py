"""Prompts out, replies in, and the decisions made over them.

Model calls stay outside: ``*_prompts`` tables go to any batch inference job, its replies come back
as tables. ``answer_prompts`` runs a caller's function over prompt partitions instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pageloom.constants import (
    NO_MATCH_REASON, SCHEMA_SAMPLES, VALIDATION_SAMPLES,
)
from pageloom.functions.replies import decode_response, reply_bool, reply_string
from pageloom.functions.sqltext import bind, lit
from pageloom.functions.text import let, nth
from pageloom.functions.urls import authority
from pageloom.operators.clean import clean_sql, main_text_sql
from pageloom.operators.html import classes, is_element, parse_pages
from pageloom.operators.ranking import first_k_per_key
from pageloom.operators.select import XPATH_PREFIX, first_items_sql, sample_items, selector_items, tree_sql
from pageloom.session import scratch_path

SELECTOR_HEAD = """Name one CSS selector for the element that repeats once per wanted item and holds
all wanted fields. Prefer tags, data attributes and structure over generated class names; give an
XPath only when no CSS selector fits, null when nothing matches.
Answer with one JSON object holding selector, xpath and reasoning, and nothing else.
Wanted: """
VALIDATION_HEAD = """Do these samples together show every kind of data that is wanted? Extra text in
a sample is fine; missing fields, menus, banners and empty samples are not.
Answer with one JSON object holding valid and reason, and nothing else.
Wanted: """
SCHEMA_HEAD = """Name the flat fields of one item.
Answer with one JSON object holding fields (a list of names) and reasoning, and nothing else.
Wanted: """


#: Tasks over which the pages of one host are dealt when they look up its selector.
HOST_SALTS = 16


def _with_id(prompts: DataFrame) -> DataFrame:
    return prompts.withColumn("prompt_id", F.sha2("prompt", 256))


def answer_prompts(prompts: DataFrame, answer: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Replies of a caller's function to the distinct prompts: prompt_id, raw."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"prompt_id": batch["prompt_id"], "raw": answer(batch["prompt"])})
    distinct = prompts.select("prompt_id", "prompt").dropDuplicates(["prompt_id"])
    return distinct.mapInPandas(run, "prompt_id string, raw string")


def selector_prompts(chunks: DataFrame, targets: DataFrame,
                     max_attempts: int | None = None) -> DataFrame:
    """One discovery prompt per chunk: page_id, attempt, prompt, prompt_id.

    ``chunks(page_id, chunk_no, html)``, ``targets(page_id, content_target)``; pages without a target
    are text pages and get none. Whole chunks are asked about, all of them unless ``max_attempts`` is given.
    """
    if max_attempts is not None:
        chunks = chunks.where(F.col("chunk_no") <= max_attempts)
    asked = chunks.select("page_id", F.col("chunk_no").alias("attempt"), F.col("html").alias("snippet"))
    wanted = targets.where(F.col("content_target") != "").select("page_id", "content_target")
    prompt = F.concat(F.lit(SELECTOR_HEAD), "content_target", F.lit("\nHTML:\n"), "snippet")
    return _with_id(asked.join(wanted, "page_id").select("page_id", "attempt", prompt.alias("prompt")))


def selector_candidates(responses: DataFrame) -> DataFrame:
    """Selector, xpath and reasoning of each discovery reply; an unreadable reply has neither."""
    decoded = responses.withColumn("_d", decode_response(F.col("raw")))
    d = F.col("_d")
    return decoded.select(
        "page_id", "attempt", reply_string(d, "$.selector").alias("selector"),
        reply_string(d, "$.xpath").alias("xpath"),
        F.coalesce(reply_string(d, "$.reasoning"), F.lit("")).alias("reasoning"))


def candidate_selector(selector: Column, xpath: Column) -> Column:
    """The selector to try: CSS when given, else the XPath with its prefix, else null."""
    css = F.nullif(selector, F.lit(""))
    return F.coalesce(css, F.concat(F.lit(XPATH_PREFIX), F.nullif(xpath, F.lit(""))))


def page_signatures(parsed: DataFrame) -> DataFrame:
    """``tag.class`` signatures of each page: host, selector, n (elements); one row per page and signature.

    Repeats are counted by one sort inside the page's row, so page coverage is a plain count of rows.
    """
    def signature(n: Column) -> Column:
        return F.concat(n["tag"], F.array_join(F.transform(
            F.array_sort(F.array_distinct(classes(n["attrs"]))), lambda c: F.concat(F.lit("."), c)), ""))

    def runs(s: Column) -> Column:
        firsts = F.filter(
            F.transform(s, lambda x, i: F.when((i == 0) | (nth(s, F.greatest(i - 1, F.lit(0))) != x), i)),
            lambda i: i.isNotNull())
        return let(firsts, lambda fs: F.transform(fs, lambda f, j: F.struct(
            nth(s, f).alias("selector"),
            (F.coalesce(nth(fs, j + 1), F.size(s)) - f).alias("n"))))

    signatures = F.array_sort(F.transform(F.filter("nodes", is_element), signature))
    return parsed.select(authority(F.col("url")).alias("host"), F.inline(let(signatures, runs)))


def _best_signatures(per_page: DataFrame, k: int) -> DataFrame:
    totals = per_page.groupBy("host", "selector").agg(
        F.sum("n").alias("elements"), F.count(F.lit(1)).alias("pages"), F.max("n").alias("most_on_page"))
    ordered = totals.withColumn("_pages", -F.col("pages")).withColumn("_elements", -F.col("elements"))
    return first_k_per_key(ordered, ["host"], ["_pages", "_elements", "selector"], F.lit(k)) \
        .drop("_pages", "_elements")


def mine_selectors(parsed: DataFrame, k: int = 20) -> DataFrame:
    """Repeating structures per host without a model: the ``k`` best ``tag.class`` signatures."""
    return _best_signatures(page_signatures(parsed), k)


def signature_candidates(per_page: DataFrame, k: int, tracked: int = 4096) -> DataFrame:
    """Per host the signatures that may be among the ``k`` on most pages, from one sketch per host.

    Result: host, n_rows, proven, selectors. The sketch of frequent items holds at most ``tracked``
    counters, whatever the host's size, and merges, so a hot host is one small row per task. With
    ``n_rows`` rows of a host, no count is wrong by more than ``3.5 * n_rows / tracked`` =: e. An estimate
    is never below the true count; what the sketch does not report has 2e pages at most, or, when the report
    is full, no more than its last estimate. ``proven`` says that the k-th estimate less e exceeds
    that, or that e is below one and nothing was cut off: then no other signature can be among the
    first ``k``, ties included. ``selectors`` are those whose estimate reaches the k-th less e.
    """
    reported = max(8 * k, 64)
    if reported > tracked:
        raise ValueError(f"tracked must be at least {reported}")
    sketched = per_page.groupBy("host").agg(
        F.expr(f"approx_top_k(selector, {reported}, {tracked})").alias("top"), F.count(F.lit(1)).alias("n_rows"))
    wrong = F.floor(F.lit(3.5) * F.col("n_rows") / F.lit(tracked))
    known = sketched.select("host", "n_rows", "top", wrong.alias("_wrong")) \
        .withColumn("_least", F.get("top", F.lit(k - 1))["count"] - F.col("_wrong"))
    full = F.size("top") >= reported
    outside = F.greatest(2 * F.col("_wrong"), F.when(full, F.element_at("top", -1)["count"]).otherwise(0))
    proven = F.coalesce(F.col("_least") > outside, F.lit(False)) | ((F.col("_wrong") == 0) & ~full)
    near = F.filter("top", lambda t: F.coalesce(t["count"] >= F.col("_least"), F.lit(True)))
    return known.select("host", "n_rows", proven.alias("proven"), F.transform(near, lambda t: t["item"]).alias("selectors"))


def mine_selectors_sketched(parsed: DataFrame, k: int = 20, tracked: int = 4096) -> DataFrame:
    """X4 for signatures without number (generated class names): the rows of ``mine_selectors``, exactly,
    but only candidates are counted.

    Signatures are stored once, so pages are parsed once. One sketch per host names the candidates
    (``signature_candidates``); counts are exact and cover candidates only, a few rows per host and
    task in the shuffle instead of every signature. Hosts whose candidates are not proven complete
    (flat counts, or fewer than ``k`` signatures on very many pages) have all their signatures counted.
    Candidates are joined as a stored table: the planner broadcasts it if its size allows, else the
    join moves the rows as the plain count does. Pages without an address share the host they have there.
    """
    spark = parsed.sparkSession
    stored, chosen = scratch_path(spark, "signatures"), scratch_path(spark, "candidates")
    page_signatures(parsed).write.parquet(stored)
    per_page = spark.read.parquet(stored)
    signature_candidates(per_page, k, tracked).write.parquet(chosen)
    hosts = spark.read.parquet(chosen).withColumnRenamed("host", "_host")
    same_host = F.col("host").eqNullSafe(F.col("_host"))
    listed = hosts.where("proven").select("_host", F.explode("selectors").alias("_selector"))
    counted = per_page.join(listed, same_host & (F.col("selector") == F.col("_selector")), "left_semi").union(
        per_page.join(hosts.where("not proven").select("_host"), same_host, "left_semi"))
    return _best_signatures(counted, k)


def _samples(items: DataFrame, keys: list[str], k: int, line: Column) -> DataFrame:
    """Up to ``k`` sampled items per key as one block of lines."""
    sampled = sample_items(items, k, keys=tuple(keys)).select(
        *keys, "sample_no", "item")
    lines = F.array_sort(F.collect_list(F.struct("sample_no", line.alias("line"))))
    return sampled.groupBy(*keys).agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("samples"),
        F.count(F.lit(1)).alias("n"))


def validation_prompts(candidates: DataFrame, pages: DataFrame, targets: DataFrame) -> DataFrame:
    """Per candidate the matches sampled into a prompt; without matches a verdict and no prompt.

    Result: page_id, attempt, selector, prompt, prompt_id, valid, reason. Samples are those of
    ``sample_items``, taken inside the page's row, where all matches of a selector are.
    """
    # exploding drops nulls without a filter, which would be pushed down and decode replies again
    tried = candidates.select("page_id", "attempt", F.explode(F.array_compact(F.array(
        candidate_selector(F.col("selector"), F.col("xpath"))))).alias("selector"))
    ranked = "array_sort(transform(items, (x, i) -> struct(md5(concat('0:', x)) as h, i as i, x as item)))"
    lines = f"transform(slice({ranked}, 1, {VALIDATION_SAMPLES}), (x, i) -> format_string('  %d. %s', i + 1, x.item))"
    samples = selector_items(pages.select("page_id", "html"), tried).select("page_id", "selector", F.expr(
        f"if(size(items) > 0, array_join({lines}, {lit(chr(10))}), null)").alias("samples"))
    prompt = F.concat(F.lit(VALIDATION_HEAD), "content_target", F.lit("\nSelector: "), "selector",
                      F.lit("\nSamples:\n"), "samples")
    joined = tried.join(targets.select("page_id", "content_target"), "page_id") \
        .join(samples, ["page_id", "selector"], "left")
    return joined.select(
        "page_id", "attempt", "selector", prompt.alias("prompt"), F.sha2(prompt, 256).alias("prompt_id"),
        F.when(F.col("samples").isNull(), False).alias("valid"),
        F.when(F.col("samples").isNull(), NO_MATCH_REASON).alias("reason"))


def validation_verdicts(responses: DataFrame) -> DataFrame:
    """Valid (missing or unreadable is false) and reason of each verdict reply."""
    key = [c for c in responses.columns if c != "raw"]
    d = F.col("_d")
    return responses.withColumn("_d", decode_response(F.col("raw"))).select(
        *key, reply_bool(d, "$.valid").alias("valid"),
        F.coalesce(reply_string(d, "$.reason"), F.lit("")).alias("reason"))


def field_coverage(records: DataFrame, field: str = "field", value: str = "value") -> DataFrame:
    """Verdict without a model from long records(job_id, field, value): share of items that have
    the field; a job is valid when every field occurs."""
    present = F.coalesce(F.col(value) != "", F.lit(False))
    shares = records.groupBy("job_id", F.col(field).alias("field")).agg(
        F.count(F.lit(1)).alias("items"), F.count_if(present).alias("present"))
    valid = shares.groupBy("job_id").agg(F.min(F.col("present") > 0).alias("valid"))
    return shares.withColumn("coverage", F.col("present") / F.col("items")).join(valid, "job_id")


def choose_selector(pages: DataFrame, tried: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per page the first attempt with matches and a valid verdict; none means text mode (null
    selector). ``tried`` is the result of ``validation_prompts``: an attempt without matches is out
    whatever a verdict says of it."""
    good = verdicts.where("valid").select("page_id", "attempt")
    picks = tried.where(F.coalesce("valid", F.lit(True))).select("page_id", "attempt", "selector") \
        .join(good, ["page_id", "attempt"], "left_semi")
    best = picks.groupBy("page_id").agg(
        F.min_by("selector", "attempt").alias("selector"), F.min("attempt").alias("attempt"))
    return pages.select("page_id").join(best, "page_id", "left")


def selector_cache(choices: DataFrame) -> DataFrame:
    """Cache rows of choices(url, selector, url_seq)."""
    return choices.where(F.col("selector").isNotNull()).groupBy("url").agg(
        F.max_by("selector", "url_seq").alias("selector"), F.min("url_seq").alias("seq"))


def lookup_selector(urls: DataFrame, cache: DataFrame) -> DataFrame:
    """urls(url) with a cached selector: that of the same URL, else the first one of its host."""
    exact = cache.select("url", F.col("selector").alias("_exact"))
    by_host = cache.groupBy(authority(F.col("url")).alias("_host")).agg(
        F.min_by("selector", "seq").alias("_hosted"))
    return (
        urls.join(exact, "url", "left").withColumn("_host", authority(F.col("url")))
        .join(by_host, "_host", "left")
        .withColumn("selector", F.coalesce("_exact", "_hosted")).drop("_exact", "_hosted", "_host"))


def host_hints(visits: DataFrame, choices: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """X9 in the order of a walk: visits(job_id, url_seq, url, ...) with ``hint``, the selector known when a page's turn comes.

    That is the cached one of its URL, else the host's first: of those of ``cache(job_id, url, seq, selector)``, known
    before the walk, else the one that an earlier page of the job found there, by ``choices(job_id, url_seq, selector)``
    (what each page finds on its own, see ``choose_selector``). A page without a host, and a host's pages up
    to the one that finds the first, have none. A page that uses a hint adds nothing new for its host, so
    the first finder does not depend on who used it.

    An as-of join with one row per job and host on its right side: an aggregate combined before the shuffle.
    Visits of a hot host are dealt over HOST_SALTS tasks.
    """
    host = authority(F.col("url"))
    salt = F.pmod(F.xxhash64("url"), F.lit(HOST_SALTS))
    found = visits.select("job_id", "url_seq", host.alias("_host")).join(
        choices.where(F.col("selector").isNotNull()).select("job_id", "url_seq", "selector"), ["job_id", "url_seq"])
    firsts = found.select("job_id", "_host", F.struct(F.lit(1).alias("late"), F.col("url_seq").cast("bigint").alias("at"), "selector").alias("entry"))
    if cache is not None:
        known = cache.where(F.col("selector").isNotNull())
        firsts = firsts.unionByName(known.select("job_id", host.alias("_host"), F.struct(
            F.lit(0).alias("late"), F.col("seq").cast("bigint").alias("at"), "selector").alias("entry")))
    firsts = firsts.groupBy("job_id", "_host").agg(F.min("entry").alias("_first")).withColumn(
        "_salt", F.explode(F.expr(f"sequence(0L, {HOST_SALTS - 1}L)")))
    hinted = visits.withColumn("_host", host).withColumn("_salt", salt).join(firsts, ["job_id", "_host", "_salt"], "left")
    earlier = (F.col("_first.late") == 0) | (F.col("_first.at") < F.col("url_seq"))
    hint = F.when(earlier, F.col("_first.selector"))
    if cache is not None:
        exact = known.groupBy("job_id", "url").agg(F.max_by("selector", "seq").alias("_exact"))
        hinted, hint = hinted.join(exact, ["job_id", "url"], "left"), F.coalesce(F.col("_exact"), hint)
    return hinted.select(*visits.columns, hint.alias("hint"))


def schema_prompts(items: DataFrame, targets: DataFrame, key: str = "page_id") -> DataFrame:
    """A prompt naming the fields of up to ten sampled items per key."""
    samples = _samples(items, [key], SCHEMA_SAMPLES, F.concat(F.lit("  - "), "item"))
    prompt = F.concat(F.lit(SCHEMA_HEAD), "content_target", F.lit("\nSamples:\n"), "samples")
    return _with_id(samples.join(targets.select(key, "content_target"), key).select(
        key, prompt.alias("prompt")))


def infer_fields(responses: DataFrame) -> DataFrame:
    """Field names of each schema reply, ``["value"]`` when it names none."""
    key = [c for c in responses.columns if c != "raw"]
    names = F.try_variant_get(decode_response(F.col("raw")), "$.fields", "array<string>")
    return responses.select(*key, let(names, lambda found: F.when(F.size(found) > 0, found).otherwise(
        F.array(F.lit("value")))).alias("fields"))


def with_choices(pages: DataFrame, targets: DataFrame, choices: DataFrame,
                 fields: DataFrame | None = None, on: str = "page_id") -> DataFrame:
    """Pages with the ``selector`` and ``fields`` that apply to them (null for text pages).

    ``targets(on, content_target)``, ``choices(on, selector)``, ``fields(on, fields)``. Joined to the
    HTML rows, before parsing makes them larger.
    """
    lookup = targets.where(F.col("content_target") != "").select(on) \
        .join(choices.where(F.col("selector").isNotNull()).select(on, "selector"), on)
    lookup = lookup.join(fields.select(on, "fields"), on, "left") if fields is not None \
        else lookup.withColumn("fields", F.lit(None).cast("array<string>"))
    return pages.join(lookup, on, "left")


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """X11: result per page: items, selector_used, schema_fields, cleaned_text, method.

    ``pages`` comes from ``with_choices``; without ``selector`` and ``fields`` columns all pages are
    text pages. A ``hint`` column (see ``host_hints``) is tried first and used, unvalidated, if it matches anything.
    A page without selector or matches is a text page: its text is its only item. Selectors
    are tried on the page cleaned once. Other columns are kept, and everything is built inside the page's row.
    """
    for name, kind in (("selector", "string"), ("hint", "string"), ("fields", "array<string>")):
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast(kind))
    # hint and selector as one tree: the first of them that yields anything is used
    tries = "if(hint is null and selector is null, null, array_distinct(array_compact(array(hint, selector))))"
    parsed = parse_pages(pages.withColumn("_tree", F.expr(tree_sql(tries))).drop("selector", "hint"), html)
    kept = [c for c in parsed.columns if c not in ("nodes", "_tree", "fields")]
    used = f"if(_tree is null, null, {bind(clean_sql('nodes'), 'tidy', first_items_sql('tidy', '_tree'))})"
    found = parsed.select(
        *kept, "fields", F.expr(main_text_sql("nodes")).alias("cleaned_text"), F.expr(used).alias("found"))
    by_selector = F.coalesce(F.size("found.items") > 0, F.lit(False))
    return found.select(
        *kept, F.when(by_selector, F.col("found.items")).otherwise(F.array("cleaned_text")).alias("items"),
        F.when(by_selector, F.col("found.selector")).alias("selector_used"),
        F.when(by_selector, F.coalesce("fields", F.array(F.lit("value"))))
        .otherwise(F.array(F.lit("content"))).alias("schema_fields"),
        "cleaned_text", F.when(by_selector, "llm_selector").otherwise("text_only").alias("method"))


def job_fields(results: DataFrame) -> DataFrame:
    """Fields of a job from results(job_id, url_seq, schema_fields): the last page's that are
    not just ``value``."""
    real = F.when(F.col("schema_fields") != F.array(F.lit("value")), F.col("url_seq"))
    return results.groupBy("job_id").agg(F.coalesce(
        F.max_by("schema_fields", real), F.array(F.lit("value"))).alias("fields"))

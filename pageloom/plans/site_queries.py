"""Queries over scope, crawl, job state and fetch attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.constants import BLOCK_SIGNATURES, JS_PHRASES
from pageloom.functions.fetch import is_blocked, needs_js
from pageloom.operators import crawl, fetch, jobs
from pageloom.plans import run
from pageloom.plans.derived import ATTEMPTS, CRAWL_EDGES, CRAWL_INTENTS, JOB_URLS
from pageloom.plans.page_queries import DISTINCT_LINKS_SQL, MAIN_TEXT_SQL
from pageloom.plans.registry import pages, query, run_sql, table
from pageloom.session import scratch_path
from pageloom.sources.readers import read_attempts, read_jobs

# Scope and crawl --------------------------------------------------------------------------------

_INTENTS = f"with i as ({CRAWL_INTENTS})"
# State of every site job: its pages as in JOB_URLS, keyed by the site root.
_STATE = JOB_URLS.replace("regexp_extract(url,'^[a-z]+://([^/?#]*)',1)", "regexp_extract(url, '^([a-z]+://[^/]*)', 1)")
# Candidates: for each site its pages in reverse order, the page after each, and some repeats.
_CANDIDATES = """
select regexp_extract(url, '^([a-z]+://[^/]*)', 1) as job_id, concat(url, '/new') as url, page_id as seq from pages
union all select regexp_extract(url, '^([a-z]+://[^/]*)', 1), url, page_id + 1000000 from pages
union all select regexp_extract(url, '^([a-z]+://[^/]*)', 1), concat(url, '/new'), page_id + 2000000 from pages
union all select regexp_extract(a.url, '^([a-z]+://[^/]*)', 1), b.url, a.page_id + 3000000 from pages a join pages b on b.page_id = a.page_id + 1
"""
_HOST_OF = "regexp_extract({}, '^[a-z]+://([^/?#]*)', 1)"
_SCOPED = f"""{_INTENTS}, s as ({_STATE}), c as ({_CANDIDATES}),
 d as (select job_id, url, min(seq) as seq from c group by job_id, url),
 a as (select d.* from d join i on i.job_id = d.job_id where {_HOST_OF.format('d.url')} = {_HOST_OF.format('i.url')}
  and not exists (select 1 from s where s.job_id = d.job_id and s.url = d.url and s.state in ('pending', 'processed'))),
 r as (select a.*, row_number() over (partition by a.job_id order by a.seq, a.url) as place from a),
 p as (select job_id, count(distinct url) as pending from s where state = 'pending' group by job_id),
 f as (select r.job_id, r.url, r.seq, r.place::bigint as place from r join i on i.job_id = r.job_id left join p on p.job_id = r.job_id
  where r.place <= i.max_urls - coalesce(p.pending, 0))"""


def _intents(spark, sf):
    return run_sql(spark, sf, CRAWL_INTENTS, "pages")


@query("seed_frontier", f"""{_INTENTS} select job_id, url, 'pending' as state from i where not exists (
 select 1 from pages p where p.url = i.url)""")
def _seed(spark, sf):
    state = run_sql(spark, sf, _STATE, "pages")
    return crawl.seed_frontier(_intents(spark, sf), state)


@query("scope_filter", f"{_SCOPED} select * from f")
def _scope(spark, sf):
    return crawl.scope_filter(run_sql(spark, sf, _CANDIDATES, "pages"), run_sql(spark, sf, _STATE, "pages"),
                              _intents(spark, sf))


@query("enqueue_links", f"""{_SCOPED} select job_id, count(*)::bigint as urls, count(*) filter (added)::bigint as added from (
 select job_id, false as added from s union all select job_id, true from f) group by job_id""")
def _enqueue(spark, sf):
    found = run_sql(spark, sf, _CANDIDATES, "pages").withColumnRenamed("url", "href")
    state = crawl.enqueue_links(found, run_sql(spark, sf, _STATE, "pages"), _intents(spark, sf))
    return state.groupBy("job_id").agg(F.count(F.lit(1)).alias("urls"), F.count_if("added").alias("added"))


@query("should_follow", """select page_id, (page_id % 3 > 0 and page_id % 4 in (0, 2)) as follow from pages""")
def _follow(spark, sf):
    kind = F.expr("case page_id % 4 when 0 then 'url_list' when 1 then 'page_content' when 2 then 'deep_content' else 'structured_data' end")
    return pages(spark, sf).select("page_id", crawl.should_follow(kind, F.col("page_id") % 3).alias("follow"))


_EDGES = f"e as ({CRAWL_EDGES})"


CRAWL_SQL = f"""with recursive i as ({CRAWL_INTENTS}), {_EDGES},
 v as (select job_id, url, 0 as hop, []::integer[] as path from i
  union select v.job_id, e.href, v.hop + 1, list_append(v.path, e.pos) from v join i on i.job_id = v.job_id join e on e.src = v.url
  where v.hop < i.depth and {_HOST_OF.format('e.href')} = {_HOST_OF.format('i.url')}),
 m as (select job_id, url, min(hop) as hop from v group by job_id, url),
 b as (select v.job_id, v.url, v.hop, min(v.path) as path from v join m on m.job_id = v.job_id and m.url = v.url and m.hop = v.hop group by v.job_id, v.url, v.hop),
 r as (select b.*, row_number() over (partition by b.job_id order by b.hop, b.path, b.url) as rank from b)
select r.job_id, r.url, r.hop::bigint as hop, r.rank::bigint as rank from r join i on i.job_id = r.job_id where r.rank <= i.max_urls"""


@query("crawl", CRAWL_SQL)
def _crawl(spark, sf):
    edges = run_sql(spark, sf, CRAWL_EDGES, "pages")
    return crawl.crawl(edges, _intents(spark, sf)).drop("label")


@query("crawl_resumed", CRAWL_SQL)
def _crawl_resumed(spark, sf):
    """Walks broken off after one hop or after two, stored, and taken up again: the same visits."""
    edges, intents = run_sql(spark, sf, CRAWL_EDGES, "pages"), _intents(spark, sf)
    last = F.when(F.length("job_id") % 3 == 0, 1).otherwise(2)
    begun = crawl.crawl(edges, intents, max_hops=2).where(F.col("hop") <= last)
    seen = begun.where(F.col("hop") < last).select("job_id", "url", F.lit("processed").alias("state"))
    path = scratch_path(spark, "walk")
    crawl.walk_state(begun, seen).write.parquet(path)
    return crawl.crawl(edges, intents, state=spark.read.parquet(path)).drop("label")


@query("whole_run", f"""select distinct v.job_id, md5(t.text) as digest from ({CRAWL_SQL}) v
 join pages p on p.url = v.url join ({MAIN_TEXT_SQL}) t on t.page_id = p.page_id""")
def _whole_run(spark, sf):
    """Walk, page results and items of every site job."""
    intents = _intents(spark, sf).withColumn("content_target", F.lit(""))
    visited = run.visited_pages(intents, table(spark, sf, "pages"), run_sql(spark, sf, CRAWL_EDGES, "pages"))
    return run.job_items(run.job_results(visited)).select("job_id", F.md5("item").alias("digest"))


@query("crawl_open", f"""with recursive i as ({CRAWL_INTENTS}), {_EDGES},
 v as (select job_id, url, 0 as hop from i
  union select v.job_id, e.href, v.hop + 1 from v join e on e.src = v.url where v.hop < 2)
select job_id, url, min(hop)::bigint as hop from v group by job_id, url""")
def _crawl_open(spark, sf):
    """Uncapped two-hop walk that may leave the host."""
    edges = run_sql(spark, sf, CRAWL_EDGES, "pages")
    intents = _intents(spark, sf).withColumn("max_urls", F.lit(0)).withColumn("depth", F.lit(2))
    return crawl.crawl(edges, intents, same_domain_only=False, max_hops=2).select("job_id", "url", "hop")


@query("crawl_summary", f"""select job_id, (count(*) filter (state = 'processed'))::bigint as processed, (count(*) filter (state = 'pending'))::bigint as pending,
 (count(*) filter (state = 'failed'))::bigint as failed from ({JOB_URLS}) group by job_id""")
def _summary(spark, sf):
    return crawl.crawl_summary(run_sql(spark, sf, JOB_URLS, "pages"))


# Job state --------------------------------------------------------------------------------------

_OUTCOMES = """select regexp_extract(url,'^[a-z]+://([^/?#]*)',1) as job_id, url,
 case when page_id % 4 = 0 then 'failed' else 'done' end as outcome from pages
union all select regexp_extract(url,'^[a-z]+://([^/?#]*)',1), concat(url, '/late'), 'done' from pages
union all select regexp_extract(url,'^[a-z]+://([^/?#]*)',1), concat(url, '/late'), 'done' from pages"""
_MARKED = f"""s as (select job_id, url, state from ({JOB_URLS})), o as (select distinct job_id, url, case outcome when 'failed' then 'failed' else 'processed' end as state from ({_OUTCOMES})),
 m as (select * from s where state = 'pending' and not exists (select 1 from o where o.job_id = s.job_id and o.url = s.url)
  union (select * from s where state <> 'pending' union select * from o))"""


def _marked(spark, sf):
    return jobs.mark_urls(run_sql(spark, sf, JOB_URLS, "pages"), run_sql(spark, sf, _OUTCOMES, "pages"))


@query("mark_urls", f"with {_MARKED} select * from m")
def _mark(spark, sf):
    return _marked(spark, sf)


@query("job_status", f"""select job_id, case when bool_or(state = 'pending') then 'running' when bool_or(state = 'failed') then 'partial' else 'complete' end as status
 from (select job_id, url, state from ({JOB_URLS}) union all select concat('done:', job_id), url, case state when 'pending' then 'processed' else state end from ({JOB_URLS})) group by job_id""")
def _status(spark, sf):
    state = run_sql(spark, sf, JOB_URLS, "pages").drop("url_seq")
    done = state.select(F.concat(F.lit("done:"), "job_id").alias("job_id"), "url",
                        F.expr("case state when 'pending' then 'processed' else state end").alias("state"))
    return jobs.job_status(state.unionByName(done))


# Job documents: one per page, its links pending, as JSON lines of which some are cut off. ---------

_JOB_ID = "concat('job_20260101_', lpad(cast(page_id as string), 8, '0'))"


def _job_documents(spark, sf):
    from pageloom.operators.html import parse_pages
    from pageloom.operators.links import page_links_sql

    parsed = parse_pages(pages(spark, sf))
    found = F.expr(page_links_sql("nodes", "url"))
    hrefs = F.transform(found, lambda l: l["href"])
    state = F.expr("case page_id % 4 when 0 then 'complete' when 1 then 'partial' when 2 then 'running' else 'pending' end")
    result = F.when(F.col("page_id") % 2 == 0, F.struct(
        F.col("url").alias("url"), F.transform(found, lambda l: F.struct(l["text"].alias("text"), l["href"].alias("href"))).alias("links"),
        F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("string").alias("selector"),
        F.lit(None).cast("string").alias("method"))).otherwise(F.struct(
            F.col("url").alias("url"), F.lit(None).cast("array<struct<text:string,href:string>>").alias("links"),
            F.transform(found, lambda l: l["text"]).alias("items"), F.lit("nav a").alias("selector"),
            F.lit("llm_selector").alias("method")))
    document = F.to_json(F.struct(
        F.concat(F.lit("get links of "), "url").alias("query"),
        F.struct("url", F.lit("url_list").alias("intent_type"), F.lit("names").alias("content_target"),
                 F.lit(25).alias("max_urls"), F.lit(1).alias("depth")).alias("intent"),
        F.expr(_JOB_ID).alias("job_id"), state.alias("status"),
        F.when(F.col("page_id") % 4 > 0, hrefs).otherwise(F.array().cast("array<string>")).alias("urls_pending"),
        F.array("url").alias("urls_processed"), F.array().cast("array<string>").alias("urls_failed"),
        F.create_map(F.lit("https://first.test/"), F.lit("h1")).alias("selector_cache"),
        F.array(result).alias("results"), F.lit("json").alias("output_format"),
        F.lit("2026-01-01T00:00:00+00:00").alias("created_at"), F.lit("2026-01-01T00:00:00+00:00").alias("updated_at")))
    return parsed.select(F.when(F.col("page_id") % 10 == 9, F.substring(document, 1, 40)).otherwise(document).alias("value"))


def job_documents(spark, sf):
    """Job documents written as JSON lines and read back through the reader."""
    path = scratch_path(spark, "jobs")
    _job_documents(spark, sf).write.text(path)
    return read_jobs(spark, path, one_per_file=False)



_JOBS = f"""j as (select {_JOB_ID} as job_id, page_id, url, case page_id % 4 when 0 then 'complete' when 1 then 'partial' when 2 then 'running' else 'pending' end as status,
 concat('get links of ', url) as query from pages where page_id % 10 <> 9),
 l as (select j.job_id, j.page_id, x.url, row_number() over (partition by x.page_id order by x.pos) - 1 as pos, x.text, x.href from ({DISTINCT_LINKS_SQL}) x join j on j.page_id = x.page_id),
 n as (select job_id, count(*) as links from l group by job_id)"""


@query("read_jobs", f"""with {_JOBS} select j.job_id, j.status, j.query, (case when page_id % 4 > 0 then links else 0 end)::bigint as pending, 1::bigint as results
 from j join n on n.job_id = j.job_id""")
def _read_jobs(spark, sf):
    return job_documents(spark, sf).select("job_id", "status", "query", F.size("urls_pending").alias("pending"),
                                           F.size("results").alias("results"))


@query("flatten_results", f"""with {_JOBS} select job_id, 'link' as kind, pos::bigint as pos, href as value from l where page_id % 2 = 0
 union all select job_id, 'item', pos::bigint, text from l where page_id % 2 = 1
 union all select job_id, 'selector', 0, 'h1' from j union all select job_id, 'selector', 1, 'nav a' from j where page_id % 2 = 1""")
def _flatten(spark, sf):
    docs = job_documents(spark, sf)
    found = jobs.saved_links(docs).select("job_id", F.lit("link").alias("kind"), "pos", F.col("href").alias("value"))
    items = jobs.saved_items(docs).select("job_id", F.lit("item").alias("kind"), "pos", F.col("item").alias("value"))
    cache = jobs.saved_selectors(docs).select("job_id", F.lit("selector").alias("kind"), F.col("seq").alias("pos"), F.col("selector").alias("value"))
    return found.unionByName(items).unionByName(cache)


@query("list_jobs", f"""with {_JOBS} select j.job_id, j.status, j.query, '2026-01-01T00:00:00+00:00' as created_at, 1::bigint as urls_processed,
 (case when page_id % 4 > 0 then links else 0 end)::bigint as urls_pending from j join n on n.job_id = j.job_id order by j.job_id desc limit 20""")
def _list_jobs(spark, sf):
    return jobs.list_jobs(job_documents(spark, sf))


@query("inspect_job", f"""with {_JOBS} select j.job_id, j.status, j.url, 'names' as content_target, 1::bigint as processed, (case when page_id % 4 > 0 then links else 0 end)::bigint as pending,
 0::bigint as failed, 1::bigint as results from j join n on n.job_id = j.job_id where j.job_id = (select max(job_id) from j)""")
def _inspect(spark, sf):
    docs = job_documents(spark, sf)
    newest = jobs.list_jobs(docs, 1).first()["job_id"]
    return jobs.inspect_job(docs, newest).drop("query", "output_path", "output_format", "created_at", "updated_at")


@query("resume_frontier", f"""with {_JOBS} select l.job_id, j.status, l.pos::bigint as url_seq, l.href as url from l join j on j.job_id = l.job_id where j.page_id % 4 > 0""")
def _resume(spark, sf):
    docs = job_documents(spark, sf)
    return jobs.resume_frontier(docs).join(jobs.resumable(docs).select("job_id", "status"), "job_id")


# Fetch attempts ---------------------------------------------------------------------------------

_LOWER_HAS = lambda words: "regexp_matches(lower(html), '" + "|".join(words) + "')"
_FLAGS = f"""f as (select *, (status_code in (403, 429, 503) or {_LOWER_HAS(BLOCK_SIGNATURES)}) as blocked, {_LOWER_HAS(JS_PHRASES)} as needs_js, html <> '' as has_html from ({ATTEMPTS})),
 g as (select *, case layer when 'httpx' then status_code = 200 and not blocked and not needs_js and error is null
  when 'playwright' then has_html and not blocked and error is null else has_html and error is null end as accepted from f),
 c as (select * exclude (n) from (select *, row_number() over (partition by url order by case when accepted then rnk else 1000000 - rnk end) as n from g) where n = 1),
 s as (select *, case when error is not null or not has_html then 'failed' else 'ok' end as outcome,
  case when error is null and has_html then null when status_code in (403, 429, 503) then concat('HTTP ', status_code) else coalesce(error, 'empty response') end as reason from c)"""


def _attempts(spark, sf):
    return run_sql(spark, sf, ATTEMPTS, "pages")


@query("read_attempts", f"select url, layer, status_code::bigint as status_code, length(html)::bigint as chars, error from ({ATTEMPTS})")
def _read_attempts(spark, sf):
    path = scratch_path(spark, "attempts")
    _attempts(spark, sf).write.parquet(path)
    return read_attempts(spark, path).select("url", "layer", "status_code", F.length("html").alias("chars"), "error")


@query("is_blocked", f"with {_FLAGS} select url, layer, blocked from f")
def _blocked(spark, sf):
    return _attempts(spark, sf).select("url", "layer", is_blocked(F.col("status_code"), F.col("html")).alias("blocked"))


@query("needs_js", f"with {_FLAGS} select url, layer, needs_js from f")
def _needs_js(spark, sf):
    return _attempts(spark, sf).select("url", "layer", needs_js(F.col("html")).alias("needs_js"))


@query("resolve_layer", f"with {_FLAGS} select url, layer, rnk::bigint as rnk, status_code::bigint as status_code, error, has_html, blocked, needs_js, accepted from c")
def _resolve_layer(spark, sf):
    return fetch.resolve_layer(_attempts(spark, sf))


_BROWSER_FLAGS = _FLAGS.replace("as accepted from f)", "as accepted from f where not (url like 'https%' and layer = 'httpx'))")


@query("resolve_layer_browser", f"""with {_BROWSER_FLAGS}
select url, layer, rnk::bigint as rnk, status_code::bigint as status_code, blocked, accepted, outcome, reason from s""")
def _resolve_layer_browser(spark, sf):
    chosen = fetch.resolve_layer(_attempts(spark, sf), browser_only=F.col("url").like("https%"))
    return fetch.fetch_status(chosen).select("url", "layer", "rnk", "status_code", "blocked", "accepted", "outcome", "reason")


@query("fetch_status", f"with {_FLAGS} select url, layer, outcome, reason from s")
def _fetch_status(spark, sf):
    return fetch.fetch_status(fetch.resolve_layer(_attempts(spark, sf))).select("url", "layer", "outcome", "reason")


@query("layer_report", f"""with {_FLAGS} select layer, status_code::bigint as status_code, outcome, count(*)::bigint as urls,
 grouping_id(layer, status_code, outcome)::bigint as level from s group by rollup (layer, status_code, outcome)""")
def _layer_report(spark, sf):
    return fetch.layer_report(fetch.fetch_status(fetch.resolve_layer(_attempts(spark, sf))))


@query("chosen_html", f"with {_FLAGS} select url, md5(html) as digest from c")
def _chosen_html(spark, sf):
    attempts = _attempts(spark, sf)
    return fetch.chosen_html(attempts, fetch.resolve_layer(attempts)).select("url", F.md5("html").alias("digest"))


# Result pages of one address: one to three per page, and a far one.
_SNAPSHOTS = """select url, page_no, concat('<html><head><title>t</title></head><body><p>', cast(page_no as string), ' ', regexp_extract(html, '<h1>([^<]*)</h1>', 1), '</p></body></html>') as html
 from (select url, html, page_id, unnest(list_value(1, 2, 3, 21)) as page_no from pages) t where page_no = 1 or page_no <= page_id % 3 + 1 or page_no = 21"""
_H1 = "replace(replace(replace(regexp_replace(regexp_extract(html, '<p>(.*)</p>', 1), '&amp;?', '&', 'g'), '&quot;', '\"'), '&', '&amp;'), '', '')"


@query("combine_pages", f"""with s as ({_SNAPSHOTS}), w as (select *, count(*) over (partition by url) as n from s)
select url, max(n)::bigint as pages, md5(case when max(n) = 1 then max(html) else concat('<html><body>', string_agg(concat('<body><p>', {_H1}, '</p></body>'), chr(10) order by page_no), '</body></html>') end) as digest
from w group by url""")
def _combine(spark, sf):
    snapshots = run_sql(spark, sf, _SNAPSHOTS, "pages")
    return fetch.combine_pages(snapshots).select("url", "pages", F.md5("html").alias("digest"))

"""Queries over request strings (I1-I15) and URL rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.constants import (
    DEEP_HINTS, FIELD_HINTS, FILE_PHRASES, FILLER_WORDS, LINK_HINTS, NO_URL_ERROR, PAGINATE_PHRASES,
)
from pageloom.functions import requests as rules
from pageloom.functions import urls
from pageloom.operators import intents as ops
from pageloom.plans.derived import REQUESTS
from pageloom.plans.registry import query, run_sql, table

_Q = f"with q as ({REQUESTS}) "
_URL = "nullif(regexp_replace(regexp_extract(query, 'https?://[^\\s\"'']+'), '[.,)]+$', ''), '')"
_NORM = f"regexp_replace({_URL}, '/+$', '')"


def _any(words: list[str]) -> str:
    return "regexp_matches(lower(query), '" + "|".join(words) + "')"


_TYPE = (f"case when {_any(LINK_HINTS)} then 'url_list' when {_any(DEEP_HINTS)} then 'deep_content' "
         f"when {_any(FIELD_HINTS)} then 'structured_data' else 'page_content' end")
# DuckDB's \b is ASCII; the words in front of a filler are matched with explicit letter classes.
_W = r"[\p{L}\p{N}_]"
_FILLER = "|".join(FILLER_WORDS)
_NO_URL = f"coalesce(replace(query, {_URL}, ''), query)"
_TARGET = (f"trim(regexp_replace(regexp_replace({_NO_URL}, '(?i)\\b({_FILLER})\\b', ' ', 'g'), '\\s{{2,}}', ' ', 'g'), ' ,.?!')")
_FORMAT = ("case when contains(lower(query), 'csv') then 'csv' "
           "when contains(lower(query), 'markdown') or contains(lower(query), ' md ') then 'md' "
           "when contains(lower(query), ' text') or contains(lower(query), ' txt') then 'text' "
           "when contains(lower(query), 'json') then 'json' end")
_HOST = f"replace(regexp_extract({_URL}, '^[a-z]+://([^/?#]*)', 1), '.', '_')"
_FILE = (f"coalesce(nullif(regexp_extract(query, '(?i)\\b([\\w.-]+\\.(json|csv|txt|md))\\b', 1), ''), "
         f"case when {_any(FILE_PHRASES)} then concat({_HOST}, '.', "
         f"case {_FORMAT} when 'text' then 'txt' when 'csv' then 'csv' when 'md' then 'md' else 'json' end) end)")
_PAGES = "try_cast(nullif(regexp_extract(lower(query), '\\b(\\d+)\\s+pages?\\b', 1), '') as bigint)"
_PAGINATE = f"({_any(PAGINATE_PHRASES)} or regexp_matches(lower(query), '\\b\\d+\\s+pages?\\b'))"


def _requests(spark, sf):
    return run_sql(spark, sf, REQUESTS, "pages")


@query("extract_url", _Q + f"select request_id, {_URL} as url from q")
def _extract_url(spark, sf):
    return _requests(spark, sf).select("request_id", urls.extract_url(F.col("query")).alias("url"))


@query("normalise_url", """
select page_id, regexp_replace(case when page_id % 2 = 0 then url else concat('https://', substr(url, strpos(url, '://') + 3)) end, '/+$', '') as url
from pages""")
def _normalise_url(spark, sf):
    bare = F.expr("case when page_id % 2 = 0 then url else substr(url, instr(url, '://') + 3) end")
    return table(spark, sf, "pages").select("page_id", urls.normalise_url(bare).alias("url"))


@query("classify_intent", _Q + f"select request_id, {_TYPE} as intent_type from q")
def _classify(spark, sf):
    return _requests(spark, sf).select("request_id", rules.classify_intent(F.col("query")).alias("intent_type"))


@query("intent_depth", _Q + f"""
select request_id, (case {_TYPE} when 'deep_content' then 2 else 0 end)::bigint as depth,
 (case {_TYPE} when 'deep_content' then 2 when 'url_list' then 0 else greatest(0, request_id % 5 - 1) end)::bigint as suggested_depth from q""")
def _depth(spark, sf):
    kind = rules.classify_intent(F.col("query"))
    suggested = (F.col("request_id") % 5 - 1).cast("string")
    return _requests(spark, sf).select("request_id", rules.intent_depth(kind).alias("depth"),
                                       rules.intent_depth(kind, suggested).alias("suggested_depth"))


@query("content_target", _Q + f"select request_id, {_TARGET} as target from q")
def _target(spark, sf):
    url = urls.extract_url(F.col("query"))
    return _requests(spark, sf).select(
        "request_id", rules.content_target(F.col("query"), url).alias("target"))


@query("output_format_hint", _Q + f"select request_id, {_FORMAT} as output_format from q")
def _format(spark, sf):
    return _requests(spark, sf).select("request_id", rules.output_format_hint(F.col("query")).alias("output_format"))


@query("output_file_hint", _Q + f"select request_id, {_FILE} as output_file from q")
def _file(spark, sf):
    q = F.col("query")
    return _requests(spark, sf).select("request_id", rules.output_file_hint(q, urls.extract_url(q)).alias("output_file"))


@query("pagination_hint", _Q + f"select request_id, {_PAGINATE} as paginate, {_PAGES} as max_pages from q")
def _pagination(spark, sf):
    q = F.col("query")
    return _requests(spark, sf).select("request_id", rules.pagination_wanted(q).alias("paginate"),
                                       rules.pagination_pages(q).alias("max_pages"))


@query("valid_values", """
select c_custkey, case when c_mktsegment in ('x') then c_mktsegment else 'page_content' end as intent_type,
 case when (c_custkey % 4) = 0 then 'json' when (c_custkey % 4) = 1 then 'md' end as output_format from customer""")
def _valid(spark, sf):
    fmt = F.expr("case c_custkey % 4 when 0 then ' JSON ' when 1 then 'md' when 2 then 'markdown' end")
    return table(spark, sf, "customer").select(
        "c_custkey", rules.valid_intent_type(F.col("c_mktsegment")).alias("intent_type"),
        rules.valid_format(fmt).alias("output_format"))


_HEAD = ops.PROMPT_HEAD.replace("'", "''")


@query("build_intent_prompts", _Q + f"""
select request_id, sha256(concat('{_HEAD}', query)) as prompt_id, length(concat('{_HEAD}', query))::bigint as chars from q""")
def _prompts(spark, sf):
    return ops.build_intent_prompts(_requests(spark, sf)).select(
        "request_id", "prompt_id", F.length("prompt").alias("chars"))


# Replies to the distinct requests, keyed by prompt.
_REPLY = """case request_id % 6
 when 0 then concat('```json', chr(10), '{"url": "', coalesce(page_url, 'https://w.test/'), '", "intent_type": "structured_data", "content_target": "", "max_urls": 7, "depth": 3, "output_format": " CSV ", "paginate": true, "max_pages": 4}', chr(10), '```')
 when 1 then '{"url": null, "intent_type": "deep_content", "content_target": " names ", "depth": 9, "output_file": "a.md", "paginate": false}'
 when 2 then 'not json at all'
 when 3 then '{"intent_type": "other", "depth": "2", "max_urls": 0, "max_pages": 0, "output_format": "pdf"}'
 when 4 then '{"url": "example.com/x/", "intent_type": "url_list", "depth": 5}'
 else '{"intent_type": "page_content", "depth": -3, "paginate": "false"}' end"""
REPLIES = f"""select min(request_id) as reply_id, query, min({_REPLY}) as raw from
 (select r.request_id, r.query, p.url as page_url from ({REQUESTS}) r join pages p on p.page_id = r.request_id) t group by query"""


def replies(spark, sf, name="raw"):
    found = run_sql(spark, sf, REPLIES, "pages")
    return found.select("reply_id", F.sha2(ops.intent_prompt(F.col("query")), 256).alias("prompt_id"), F.col("raw").alias(name))


_DECODED = f"""
with q as ({REQUESTS}), r as ({REPLIES}),
d as (select q.request_id, q.query, case when json_valid(j) then j end as j from q join (
  select query, trim(regexp_replace(regexp_replace(raw, '^```json\\s*', ''), '\\s*```$', ''), chr(10)) as j from r) r on r.query = q.query),
e as (select request_id, query, j, coalesce(nullif(json_extract_string(j, '$.url'), ''), {_URL}) as u,
  case when json_extract_string(j, '$.intent_type') in ('url_list','page_content','structured_data','deep_content')
   then json_extract_string(j, '$.intent_type') else 'page_content' end as t,
  trim(coalesce(json_extract_string(j, '$.content_target'), '')) as c from d),
i as (select request_id, case when u like '%://%' then regexp_replace(u, '/+$', '') else concat('https://', regexp_replace(u, '/+$', '')) end as url,
  t as intent_type, case when c = '' and t in ('structured_data', 'deep_content')
   then trim(regexp_replace(regexp_replace(coalesce(replace(query, u, ''), query), '(?i)\\b({_FILLER})\\b', ' ', 'g'), '\\s{{2,}}', ' ', 'g'), ' ,.?!') else c end as content_target,
  coalesce(json_extract_string(j, '$.max_urls')::bigint, 0) as max_urls,
  (case t when 'deep_content' then 2 when 'url_list' then 0 else greatest(0, coalesce(json_extract_string(j, '$.depth')::bigint, 0)) end)::bigint as depth,
  case when lower(trim(json_extract_string(j, '$.output_format'))) in ('json','csv','md','text') then lower(trim(json_extract_string(j, '$.output_format'))) end as output_format,
  json_extract_string(j, '$.output_file') as output_file,
  coalesce(json_extract_string(j, '$.paginate') = 'true', false) as paginate,
  nullif(json_extract_string(j, '$.max_pages')::bigint, 0) as max_pages,
  case when j is null then 'The reply is not JSON.' when u is null then '{NO_URL_ERROR}' end as error from e)
"""


@query("parse_intent_response", _DECODED + "select * from i")
def _parse_reply(spark, sf):
    return ops.parse_intent_response(_requests(spark, sf), replies(spark, sf))


_WORDING = f"""select request_id, {_NORM} as url, {_TYPE} as intent_type, {_TARGET} as content_target, 0::bigint as max_urls,
 (case {_TYPE} when 'deep_content' then 2 else 0 end)::bigint as depth, {_FORMAT} as output_format, {_FILE} as output_file,
 {_PAGINATE} as paginate, {_PAGES} as max_pages, case when {_URL} is null then '{NO_URL_ERROR}' end as error from q"""


@query("resolve_intents", _DECODED + f""", h as ({_WORDING})
select h.request_id, case when i.request_id is not null then i.url else h.url end as url,
 case when i.request_id is not null then i.intent_type else h.intent_type end as intent_type,
 case when i.request_id is not null then i.max_urls else h.max_urls end as max_urls,
 case when i.request_id is not null then i.depth else h.depth end as depth,
 case when i.request_id is not null then i.output_file else h.output_file end as output_file,
 case when i.request_id is not null then 'primary' else 'wording' end as source,
 case when i.request_id is null then h.error end as error
from h left join (select * from i where error is null) i on i.request_id = h.request_id""")
def _resolve(spark, sf):
    found = ops.resolve_intents(_requests(spark, sf), replies(spark, sf))
    return found.select("request_id", "url", "intent_type", "max_urls", "depth", "output_file", "source", "error")


# A second model answers every request whose number 3 does not divide: by an address and a format of its own,
# every fifth time without any JSON.
SECOND_REPLIES = f"""select query, case when min(request_id) % 5 = 0 then 'sorry' else concat('{{"url": "https://second.example.com/',
 cast(min(request_id) as string), '/", "intent_type": "url_list", "max_urls": 7, "output_format": "CSV"}}') end as raw
 from ({REQUESTS}) t where request_id % 3 <> 0 group by query"""


@query("resolve_intents_both", _DECODED + f""", h as ({_WORDING}), s as ({SECOND_REPLIES}),
b as (select q.request_id, regexp_replace(json_extract_string(s.raw, '$.url'), '/+$', '') as url
 from q join s on s.query = q.query where json_valid(s.raw))
select h.request_id, case when i.request_id is not null then i.url when b.request_id is not null then b.url else h.url end as url,
 case when i.request_id is not null then i.intent_type when b.request_id is not null then 'url_list' else h.intent_type end as intent_type,
 case when i.request_id is not null then i.max_urls when b.request_id is not null then 7 else h.max_urls end as max_urls,
 case when i.request_id is not null then i.output_format when b.request_id is not null then 'csv' else h.output_format end as output_format,
 case when i.request_id is not null then 'primary' when b.request_id is not null then 'secondary' else 'wording' end as source,
 case when i.request_id is null and b.request_id is null then h.error end as error
from h left join (select * from i where error is null) i on i.request_id = h.request_id left join b on b.request_id = h.request_id""")
def _resolve_both(spark, sf):
    second = run_sql(spark, sf, SECOND_REPLIES, "pages").select(
        F.sha2(ops.intent_prompt(F.col("query")), 256).alias("prompt_id"), "raw")
    found = ops.resolve_intents(_requests(spark, sf), replies(spark, sf), second)
    return found.select("request_id", "url", "intent_type", "max_urls", "output_format", "source", "error")


@query("explicit_intents", """
select page_id as request_id, url, case when page_id % 2 = 0 then 'structured_data' else 'page_content' end as intent_type,
 case when page_id % 2 = 0 then 'title' else '' end as content_target,
 (page_id % 3)::bigint as max_urls,
 (case when page_id % 4 = 3 then 1 else page_id % 4 end)::bigint as depth from pages""")
def _explicit(spark, sf):
    given = table(spark, sf, "pages").select(
        F.col("page_id").alias("request_id"), "url", F.expr("case when page_id % 2 = 0 then 'title' end").alias("target"),
        (F.col("page_id") % 3).alias("max_urls"), F.expr("case when page_id % 4 < 3 then page_id % 4 end").alias("depth"))
    return ops.explicit_intents(given).select("request_id", "url", "intent_type", "content_target", "max_urls", "depth")


OVERRIDES = """select page_id as request_id, cast(case when page_id % 3 = 0 then 9 when page_id % 3 = 1 then 0 end as int) as max_urls,
 cast(case when page_id % 5 = 0 then 0 end as int) as depth, case when page_id % 7 = 0 then 'names' when page_id % 7 = 1 then '' end as target,
 case when page_id % 4 = 0 then 'csv' when page_id % 4 = 1 then 'json' end as format,
 case when page_id % 9 = 0 then 'mine.txt' end as output, page_id % 11 = 0 as paginate,
 cast(case when page_id % 6 = 0 then 2 end as int) as max_pages from pages"""


@query("apply_overrides", _Q + f""", h as ({_WORDING}), o as ({OVERRIDES})
select h.request_id, case when o.target <> '' then o.target else h.content_target end as content_target,
 coalesce(o.max_urls, h.max_urls)::bigint as max_urls, coalesce(o.depth, h.depth)::bigint as depth,
 case when o.output is null and h.output_file is not null then coalesce(h.output_format, o.format, 'json')
      when h.output_format is not null and coalesce(o.format, 'json') = 'json' then h.output_format
      else coalesce(o.format, 'json') end as format,
 coalesce(o.output, h.output_file) as output, (o.paginate or h.paginate) as paginate,
 coalesce(o.max_pages, h.max_pages)::bigint as max_pages
from h join o on o.request_id = h.request_id""")
def _overrides(spark, sf):
    given = run_sql(spark, sf, OVERRIDES, "pages")
    return ops.apply_overrides(ops.heuristic_intents(_requests(spark, sf)), given).drop("url", "intent_type")


@query("plan_report", _Q + f""", h as ({_WORDING}) select request_id,
 concat('{{"job_id":"job_', request_id, '","intent":{{"url":', case when url is null then 'null' else concat('"', url, '"') end,
 ',"intent_type":"', intent_type, '","content_target":', to_json(content_target)::varchar,
 ',"max_urls":', max_urls, ',"depth":', depth, '}}}}') as plan from h""")
def _plan(spark, sf):
    return ops.plan_report(ops.heuristic_intents(_requests(spark, sf)))


# URL rules -------------------------------------------------------------------------------------

_BASE = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_HREFS = """select page_id, url, k, case k when 0 then concat('/p/', page_id, '?x=1') when 1 then concat('//cdn.test/a', page_id)
 when 2 then 'tel:123' when 3 then '?q=2' when 4 then concat('item', page_id) when 5 then '../up' when 6 then './here/./x' else 'https://abs.test/a/../b' end as href
 from (select page_id, url, unnest(list_value(0, 1, 2, 3, 4, 5, 6, 7)) as k from pages) t"""
_DIR = f"regexp_replace({_PATH}, '[^/]*$', '')"
_UP = f"regexp_replace({_DIR}, '[^/]+/$', '')"


@query("resolve_href", f"""with h as ({_HREFS}) select page_id, k::bigint as k, case k
 when 0 then concat({_BASE}, href) when 1 then concat(regexp_extract(url, '^[a-z]+:'), href) when 2 then href
 when 3 then concat({_BASE}, {_PATH}, href) when 4 then concat({_BASE}, {_DIR}, href)
 when 5 then concat({_BASE}, {_UP}, 'up') when 6 then concat({_BASE}, {_DIR}, 'here/x') else href end as href from h""")
def _resolve_href(spark, sf):
    return run_sql(spark, sf, _HREFS, "pages").select(
        "page_id", "k", urls.resolve_href("url", "href").alias("href"))


@query("strip_fragment", "select page_id, split_part(url, '#', 1) as url from pages")
def _strip_fragment(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.strip_fragment(F.col("url")).alias("url"))


@query("same_domain", """select a.page_id, coalesce(split_part(split_part(a.url, '/', 3), '?', 1) = split_part(split_part(b.url, '/', 3), '?', 1), false) as same
from pages a left join pages b on b.page_id = a.page_id + 58""")
def _same_domain(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    other = p.select((F.col("page_id") - 58).alias("page_id"), F.col("url").alias("other"))
    same = F.coalesce(urls.same_domain(F.col("url"), F.col("other")), F.lit(False))  # no other page: not the same
    return p.join(other, "page_id", "left").select("page_id", same.alias("same"))

"""Queries over items, extraction decisions, output and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from pageloom.functions.items import match_key, split_parts
from pageloom.functions.replies import decode_response, reply_string
from pageloom.functions.urls import authority
from pageloom.operators import chunks as chunk_ops, clean, extract, items, jobs
from pageloom.operators.links import extract_links
from pageloom.plans import run
from pageloom.plans.derived import ITEMS, JOB_METADATA, SELECTOR_RESPONSES, TEXT_ITEMS
from pageloom.plans.page_queries import (
    CHUNKS_SQL, _LINKS, _PARAGRAPHS, DISTINCT_LINKS_SQL, MAIN_TEXT_SQL, MENU_ITEMS_SQL, _decoded, _pieces, _trimmed,
)
from pageloom.plans.registry import ORACLES, pages, parsed, query, run_sql, table
from pageloom.session import scratch_path
from pageloom.sources import documents, sinks
from pageloom.sources.readers import read_responses
from pageloom.streaming import job_state, streams

RUN_AT = "2026-01-01T00:00:00+00:00"
FIELDS = {"customers": ["name", "url"], "parts": ["title", "brand", "size"], "segments": ["name", "url"]}


def _quoted(text: str) -> str:
    return text.replace("'", "''")


# Extraction decisions ---------------------------------------------------------------------------

def _responses(spark, sf):
    return run_sql(spark, sf, SELECTOR_RESPONSES, "pages")


_UNFENCED = "trim(regexp_replace(regexp_replace(raw, '^```json\\s*', ''), '\\s*```$', ''), chr(10))"
_CANDIDATES = f"""c as (select page_id, attempt, json_extract_string(j, '$.selector') as selector, json_extract_string(j, '$.xpath') as xpath, verdict from (
 select page_id, attempt, verdict, {_UNFENCED} as j from ({SELECTOR_RESPONSES})))"""
# Selectors see cleaned pages: ``nav a`` (menus) and ``table td`` (no tables) match nothing.
_SELECTED = f"""x as (select page_id, 'article > h1' as selector, 0 as pos, array_to_string({_pieces("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}, chr(10)) as item from pages
 union all select page_id, 'div.ad', 0, array_to_string({_pieces("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)")}, chr(10)) from pages
 union all select page_id, 'article p', pos, array_to_string({_pieces('p')}, chr(10)) from ({_PARAGRAPHS})
 union all select page_id, 'xpath://p', pos, {_trimmed(_decoded("regexp_replace(p, '<[^>]*>', '', 'g')"))} from ({_PARAGRAPHS}))"""
_CHOSEN = f"""{_CANDIDATES}, {_SELECTED}, t as (select page_id, attempt, coalesce(selector, concat('xpath:', xpath)) as selector, verdict like '%true%' as valid from c
 where selector is not null or xpath is not null),
 b as (select page_id, arg_min(selector, attempt) as selector, min(attempt) as attempt from t where valid and (page_id, selector) in (select page_id, selector from x where item <> '') group by page_id)"""


@query("read_responses", f"select page_id, attempt::bigint as attempt, verdict as raw from ({SELECTOR_RESPONSES})")
def _read_responses(spark, sf):
    path = scratch_path(spark, "responses")
    replies = _responses(spark, sf)
    replies.select("page_id", "attempt", F.explode(F.array(
        F.struct(F.lit("selector").alias("kind"), F.col("raw").alias("raw")),
        F.struct(F.lit("verdict").alias("kind"), F.col("verdict").alias("raw")))).alias("r")) \
        .select("page_id", "attempt", "r.*").write.parquet(path)
    return read_responses(spark, path, "verdict").drop("kind")


@query("decode_response", f"""select page_id, attempt::bigint as attempt, json_extract_string({_UNFENCED}, '$.selector') as selector,
 json_valid(verdict) as verdict_readable from ({SELECTOR_RESPONSES})""")
def _decode(spark, sf):
    return _responses(spark, sf).select(
        "page_id", "attempt", reply_string(decode_response(F.col("raw")), "$.selector").alias("selector"),
        decode_response(F.col("verdict")).isNotNull().alias("verdict_readable"))


_DOC_CHUNKS = "select doc_id as page_id, (i // 6000 + 1) as chunk_no, substr(text, i + 1, 6000) as html from (select doc_id, text, unnest(range(0, length(text)::bigint, 6000)) as i from documents)"


@query("selector_prompts", f"""select page_id, chunk_no::bigint as attempt, sha256(concat('{_quoted(extract.SELECTOR_HEAD)}', source, chr(10), 'HTML:', chr(10), html)) as prompt_id
 from ({_DOC_CHUNKS}) c join (select doc_id, source from documents where source <> '') d on d.doc_id = c.page_id""")
def _selector_prompts(spark, sf):
    docs = table(spark, sf, "documents")
    cut = clean.chunk_text(docs.select(F.col("doc_id").alias("page_id"), "text")).withColumnRenamed("chunk", "html")
    targets = docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("content_target"))
    return extract.selector_prompts(cut, targets).drop("prompt")


@query("page_selector_prompts", f"""with {CHUNKS_SQL} select page_id, chunk_no as attempt,
 sha256(concat('{_quoted(extract.SELECTOR_HEAD)}', 'names', chr(10), 'HTML:', chr(10), html)) as prompt_id from chunks""")
def _page_selector_prompts(spark, sf):
    """Discovery prompts over the chunks of cleaned pages."""
    found = chunk_ops.chunk_pages(clean.clean_pages(parsed(spark, sf).select("page_id", "nodes")))
    targets = pages(spark, sf).select("page_id", F.lit("names").alias("content_target"))
    return extract.selector_prompts(found, targets).drop("prompt")


@query("selector_candidates", f"with {_CANDIDATES} select page_id, attempt::bigint as attempt, selector, xpath, '' as reasoning from c")
def _candidates(spark, sf):
    return extract.selector_candidates(_responses(spark, sf))


@query("validation_prompts", f"""with {_CHOSEN},
 r as (select *, row_number() over (partition by page_id, selector order by md5(concat('0:', item)), pos) as n from x where item <> ''),
 s as (select page_id, selector, string_agg(concat('  ', n, '. ', item), chr(10) order by n) as samples from r where n <= 5 group by page_id, selector)
select t.page_id, t.attempt::bigint as attempt, t.selector, sha256(concat('{_quoted(extract.VALIDATION_HEAD)}', 'names', chr(10), 'Selector: ', t.selector, chr(10), 'Samples:', chr(10), nullif(s.samples, ''))) as prompt_id,
 case when s.samples is null then false end as valid, case when s.samples is null then 'Selector returned 0 elements.' end as reason
from t left join s on s.page_id = t.page_id and s.selector = t.selector""".replace(
    "sha256(concat('", "case when s.samples is not null then sha256(concat('", 1).replace("nullif(s.samples, '')))", "s.samples)) end"))
def _validation_prompts(spark, sf):
    targets = table(spark, sf, "pages").select("page_id", F.lit("names").alias("content_target"))
    found = extract.selector_candidates(_responses(spark, sf))
    return extract.validation_prompts(found, pages(spark, sf), targets).drop("prompt")


@query("validation_verdicts", f"""select page_id, attempt::bigint as attempt, verdict like '%true%' as valid,
 case when verdict like '%"ok"%' then 'ok' else '' end as reason from ({SELECTOR_RESPONSES})""")
def _verdicts(spark, sf):
    replies = _responses(spark, sf).select("page_id", "attempt", F.col("verdict").alias("raw"))
    return extract.validation_verdicts(replies)


def _choices(spark, sf):
    replies = _responses(spark, sf)
    verdicts = extract.validation_verdicts(replies.select("page_id", "attempt", F.col("verdict").alias("raw")))
    targets = table(spark, sf, "pages").select("page_id", F.lit("names").alias("content_target"))
    tried = extract.validation_prompts(extract.selector_candidates(replies), pages(spark, sf), targets)
    return extract.choose_selector(table(spark, sf, "pages"), tried, verdicts)


@query("choose_selector", f"with {_CHOSEN} select p.page_id, b.selector, b.attempt::bigint as attempt from pages p left join b on b.page_id = p.page_id")
def _choose(spark, sf):
    return _choices(spark, sf)


@query("lookup_selector", f"""with {_CHOSEN}, k as (select p.url, b.selector, p.page_id as seq, regexp_extract(p.url, '^[a-z]+://([^/?#]*)', 1) as host from pages p join b on b.page_id = p.page_id),
 h as (select host, arg_min(selector, seq) as selector from k group by host)
select p.url, coalesce(k.selector, h.selector) as selector from pages p left join k on k.url = p.url left join h on h.host = regexp_extract(p.url, '^[a-z]+://([^/?#]*)', 1)""")
def _lookup(spark, sf):
    urls = table(spark, sf, "pages").select("page_id", "url")
    choices = _choices(spark, sf).join(urls, "page_id").withColumnRenamed("page_id", "url_seq")
    return extract.lookup_selector(urls.select("url"), extract.selector_cache(choices))


# One job visits all pages in the order of page_id; every seventh page's selector was known before, those of two hosts' last pages too.
_HOST = "regexp_extract({}, '^[a-z]+://([^/?#]*)', 1)"
_KNOWN = """select 'all' as job_id, url, page_id as seq, case page_id % 2 when 0 then 'article > h1' else 'nav a' end as selector from pages where page_id % 97 = 5
 union all select 'all', 'https://never.seen.example/', 0, 'p' from region where r_regionkey = 0"""
_HINTED = f"""{_CHOSEN}, v as (select p.page_id, p.url, {_HOST.format('p.url')} as host, b.selector from pages p left join b on b.page_id = p.page_id),
 known as ({_KNOWN}), ko as (select {_HOST.format('url')} as host, arg_min(selector, seq) as selector from known group by host),
 f as (select host, arg_min(selector, page_id) as selector, min(page_id) as place from v where selector is not null group by host),
 hinted as (select v.*, coalesce(known.selector, ko.selector, case when f.place < v.page_id then f.selector end) as hint from v
  left join known on known.url = v.url left join ko on ko.host = v.host left join f on f.host = v.host),
 used as (select *, case when hint is not null and (page_id, hint) in (select page_id, selector from x where item <> '') then hint else selector end as selector_used from hinted)"""


def _visits(spark, sf):
    return table(spark, sf, "pages").select(F.lit("all").alias("job_id"), F.col("page_id").alias("url_seq"), "url")


@query("host_hints", f"with {_HINTED} select page_id, hint from used")
def _host_hints(spark, sf):
    """The selector known to each page when its turn comes."""
    choices = _choices(spark, sf).select(F.lit("all").alias("job_id"), F.col("page_id").alias("url_seq"), "selector")
    found = extract.host_hints(_visits(spark, sf), choices, run_sql(spark, sf, _KNOWN, "pages", "region"))
    return found.select(F.col("url_seq").alias("page_id"), "hint")


@query("extract_hinted", f"""with {_HINTED}, m as ({MAIN_TEXT_SQL}),
 i as (select u.page_id, count(*) as n, string_agg(x.item, chr(1) order by x.pos) as items from used u join x on x.page_id = u.page_id and x.selector = u.selector_used and x.item <> '' group by u.page_id)
select m.page_id, u.selector_used, coalesce(i.n, 1)::bigint as items, md5(coalesce(i.items, m.text)) as item_digest from m join used u on u.page_id = m.page_id left join i on i.page_id = m.page_id""")
def _extract_hinted(spark, sf):
    """Whole results of one job over all pages: hints that match, else what a page finds itself, else its text."""
    visited = pages(spark, sf).select(
        F.lit("all").alias("job_id"), F.col("page_id").alias("url_seq"), "page_id", "url", "html",
        F.lit("deep_content").alias("intent_type"), F.lit("names").alias("content_target"))
    choices = _choices(spark, sf).join(table(spark, sf, "pages").select("page_id", "url"), "page_id")
    results = run.job_results(visited, choices, cache=run_sql(spark, sf, _KNOWN, "pages", "region"))
    return results.select("page_id", "selector_used", F.size("items").alias("items"), F.md5(F.array_join("items", "\x01")).alias("item_digest"))


_COVERAGE_VALUES = """select lang as job_id, 'source' as field, source as value from documents
 union all select lang, 'quality', cast(quality as string) from documents d left join labels l on l.doc_id = d.doc_id
 union all select lang, 'never', case when lang = 'xx' then 'x' else '' end from documents"""


@query("field_coverage", f"""with s as (select job_id, field, count(*)::bigint as items, (count(*) filter (coalesce(value <> '', false)))::bigint as present from ({_COVERAGE_VALUES}) group by job_id, field)
select job_id, field, items, present, present / items as coverage, min(present) over (partition by job_id) > 0 as valid from s""")
def _coverage(spark, sf):
    return extract.field_coverage(run_sql(spark, sf, _COVERAGE_VALUES, "documents", "labels"))


@query("schema_prompts", f"""with r as (select doc_id, lang, text, row_number() over (partition by lang order by md5(concat('0:', text)), doc_id) as n from documents),
 s as (select lang, string_agg(concat('  - ', text), chr(10) order by n) as samples from r where n <= 10 group by lang)
select lang, sha256(concat('{_quoted(extract.SCHEMA_HEAD)}', lang, chr(10), 'Samples:', chr(10), samples)) as prompt_id from s""")
def _schema_prompts(spark, sf):
    docs = table(spark, sf, "documents").select("lang", F.col("doc_id").alias("pos"), F.col("text").alias("item"))
    targets = docs.select("lang").distinct().withColumn("content_target", F.col("lang"))
    return extract.schema_prompts(docs, targets, key="lang").drop("prompt")


_FIELD_REPLIES = """select page_id, case page_id % 4 when 0 then '{"fields": ["title", "price"], "reasoning": "x"}' when 1 then '{"fields": []}'
 when 2 then 'no json' else concat('```', chr(10), '{"fields": ["id", 7]}', chr(10), '```') end as raw from pages"""


@query("infer_fields", """select page_id, case page_id % 4 when 0 then 'title,price' when 3 then 'id,7' else 'value' end as fields from pages""")
def _infer(spark, sf):
    found = extract.infer_fields(run_sql(spark, sf, _FIELD_REPLIES, "pages"))
    return found.select("page_id", F.array_join("fields", ",").alias("fields"))


@query("extract", f"""with {_CHOSEN}, m as ({MAIN_TEXT_SQL}),
 i as (select b.page_id, count(*) as n, string_agg(x.item, chr(1) order by x.pos) as items from b join x on x.page_id = b.page_id and x.selector = b.selector and x.item <> '' group by b.page_id),
 e as (select m.page_id, m.text, b.selector, i.n, i.items, (i.n is not null and m.page_id % 4 <> 0) as sel from m left join b on b.page_id = m.page_id left join i on i.page_id = m.page_id)
select page_id, case when sel then selector end as selector_used, case when sel then 'llm_selector' else 'text_only' end as method,
 (case when sel then n else 1 end)::bigint as items, md5(case when sel then items else text end) as item_digest, md5(text) as text_digest,
 case when not sel then 'content' when page_id % 4 = 3 then 'id,7' else 'value' end as schema_fields from e""")
def _extract(spark, sf):
    targets = table(spark, sf, "pages").select("page_id", F.expr("case when page_id % 4 = 0 then '' else 'names' end").alias("content_target"))
    fields = extract.infer_fields(run_sql(spark, sf, _FIELD_REPLIES, "pages"))
    results = extract.extract(extract.with_choices(pages(spark, sf), targets, _choices(spark, sf), fields))
    return results.select(
        "page_id", "selector_used", "method", F.size("items").alias("items"),
        F.md5(F.array_join("items", "\x01")).alias("item_digest"), F.md5("cleaned_text").alias("text_digest"),
        F.array_join("schema_fields", ",").alias("schema_fields"))


@query("job_fields", """with r as (select regexp_extract(url,'^[a-z]+://([^/?#]*)',1) as job_id, page_id as seq, case page_id % 4 when 0 then 'title,price' when 3 then 'id,7' else 'value' end as f from pages),
 m as (select job_id, arg_max(f, seq) filter (f <> 'value') as f from r group by job_id) select job_id, coalesce(f, 'value') as fields from m""")
def _job_fields(spark, sf):
    found = extract.infer_fields(run_sql(spark, sf, _FIELD_REPLIES, "pages")).join(table(spark, sf, "pages").select("page_id", "url"), "page_id")
    results = found.select(authority(F.col("url")).alias("job_id"), F.col("page_id").alias("url_seq"), F.col("fields").alias("schema_fields"))
    return extract.job_fields(results).select("job_id", F.array_join("fields", ",").alias("fields"))


# Items ------------------------------------------------------------------------------------------

_ITEM_TABLES = ("customer", "part")


def _items(spark, sf):
    return run_sql(spark, sf, ITEMS, *_ITEM_TABLES)


def _text_items(spark, sf):
    return run_sql(spark, sf, TEXT_ITEMS, "documents")


_SQL_PARTS = f"list_filter(list_transform(string_split_regex(item, '\\n|\\|'), lambda t: {_trimmed('t')}), lambda t: t <> '')"


@query("split_parts", f"""select job_id, url_seq::bigint as url_seq, len({_SQL_PARTS})::bigint as parts, array_to_string({_SQL_PARTS}, '#') as joined
 from (({ITEMS}) union all ({TEXT_ITEMS}))""")
def _split(spark, sf):
    every = _items(spark, sf).unionByName(_text_items(spark, sf))
    return every.select("job_id", "url_seq", split_parts(F.col("item")).alias("p")).select(
        "job_id", "url_seq", F.size("p").alias("parts"), F.array_join("p", "#").alias("joined"))


@query("match_key", f"""with p as (select job_id, url_seq, unnest({_SQL_PARTS}) as part from ({ITEMS})),
 k as (select *, lower(regexp_extract(part, '^(\\w[\\w-]*):\\s+(.+)$', 1)) as key from p)
select job_id, url_seq::bigint as url_seq, part, case when key = '' then null when key = 'name' then 'fullname' when key = 'url' then 'url' when key = 'size' then 'siz' end as field from k""")
def _match(spark, sf):
    parts = _items(spark, sf).select("job_id", "url_seq", F.explode(split_parts(F.col("item"))).alias("part"))
    return parts.withColumn("field", match_key(F.col("part"), ["title", "fullname", "url", "siz", "name"]))


@query("normalise_items", """select 'customers' as job_id, c_custkey as url_seq, 'name' as field, c_name as value from customer
 union all select 'customers', c_custkey, 'url', concat('/c/', c_custkey % 400) from customer
 union all select 'parts', p_partkey, 'title', p_name from part union all select 'parts', p_partkey, 'brand', p_brand from part
 union all select 'parts', p_partkey, 'size', p_size::varchar from part
 union all select 'segments', c_custkey, 'name', c_mktsegment from customer union all select 'segments', c_custkey, 'url', concat('/n/', c_nationkey) from customer""")
def _normalise(spark, sf):
    fields = F.create_map(*[x for job, names in FIELDS.items() for x in (F.lit(job), F.array(*[F.lit(n) for n in names]))])
    found = items.normalise_items(_items(spark, sf).withColumn("fields", F.element_at(fields, F.col("job_id"))), F.col("fields"))
    return found.select("job_id", "url_seq", F.explode("record").alias("field", "value"))


def _sql_n3(source: str, fields: list[str]) -> str:
    """N3 in SQL over ``source`` (which has ``item``): its columns plus one column per field."""
    word = "[\\p{L}\\p{N}_]"
    keyed = f"^({word}[\\p{{L}}\\p{{N}}_-]*):\\s+(.+)$"
    key = f"lower(regexp_extract(t, '{keyed}', 1))"
    field = "case when {k} = '' then null " + " ".join(
        f"when contains('{f.lower()}', {{k}}) or contains({{k}}, '{f.lower()}') then '{f}'" for f in fields) + " end"
    at = [f"coalesce(list_position(k, '{f}'), 0)" for f in fields]
    cols = []
    for i, f in enumerate(fields):
        opened = " + ".join(["1"] + [f"(case when {a} = 0 then 1 else 0 end)" for a in at[:i]])
        cols.append(f"case when {at[i]} > 0 then regexp_extract(p[{at[i]}], '{keyed}', 2) else coalesce(l[{opened}], '') end as {f}")
    return f"""select * exclude (p, k, l), {', '.join(cols)} from (
 select *, list_filter(p, lambda t, i: k[i] is null or list_position(k, k[i]) <> i) as l from (
 select *, list_transform(p, lambda t: {field.format(k=key)}) as k from (select *, {_SQL_PARTS} as p from ({source}))))"""


_KEYED_TEXTS = """select lang as job_id, doc_id as url_seq, concat(text, chr(10), 'Second: ', source, chr(10), 'third: x', chr(10), 'third: y') as item from documents
 union all select concat(lang, '?'), doc_id, text from documents"""


@query("normalise_texts", f"select job_id, url_seq, first, second, third from ({_sql_n3(_KEYED_TEXTS, ['first', 'second', 'third'])})")
def _normalise_texts(spark, sf):
    """Whole texts under three fields, with and without keyed lines."""
    return items.records_wide(run_sql(spark, sf, _KEYED_TEXTS, "documents"), ["first", "second", "third"])


@query("links_display", f"select page_id, pos, text, href, concat(text, ' → ', href) as item from ({DISTINCT_LINKS_SQL})")
def _links_display(spark, sf):
    return items.links_display(extract_links(parsed(spark, sf)))


def _meta(spark, sf, source):
    return items.result_metadata(source, run_sql(spark, sf, JOB_METADATA, "region"), RUN_AT)


_META = f"""meta as (select j.job_id, j.url, '{RUN_AT}' as timestamp, (select count(*) from ({ITEMS}) i where i.job_id = j.job_id)::bigint as item_count,
 j.selector, j.method, case when j.method = 'llm_selector' then 'high' else 'low' end as confidence from ({JOB_METADATA}) j)"""


@query("result_metadata", f"with {_META} select * from meta")
def _metadata(spark, sf):
    return _meta(spark, sf, _items(spark, sf))


@query("with_placeholder", f"""select job_id, url_seq::bigint as url_seq, item, false as placeholder from ({ITEMS})
 union all select job_id, 0, 'No data extracted.', true from ({JOB_METADATA}) where job_id in ('empty', 'idle')""")
def _placeholder(spark, sf):
    return items.with_placeholder(_items(spark, sf), run_sql(spark, sf, JOB_METADATA, "region")).drop("pos")


_FIRST = f"select * exclude (n) from (select *, row_number() over (partition by job_id, item order by url_seq, pos) as n from (({TEXT_ITEMS}) union all ({ITEMS}))) where n = 1"


def _all_items(spark, sf):
    return _text_items(spark, sf).unionByName(_items(spark, sf))


@query("dedup_items", f"select job_id, url_seq::bigint as url_seq, pos::bigint as pos, md5(item) as digest from ({_FIRST})")
def _dedup(spark, sf):
    return items.dedup_items(_all_items(spark, sf)).select("job_id", "url_seq", "pos", F.md5("item").alias("digest"))


@query("dedup_links", f"""select job_id, text, href, min(page_id)::bigint as url_seq from (
 select regexp_extract(url,'^[a-z]+://([^/?#]*)',1) as job_id, page_id, text, href from ({DISTINCT_LINKS_SQL})) group by job_id, text, href""")
def _dedup_links(spark, sf):
    found = extract_links(parsed(spark, sf).withColumn("url_seq", F.col("page_id")).select(
        F.struct(authority(F.col("url")).alias("job_id"), F.col("page_id").alias("url_seq")).alias("key"), "url", "nodes"), key="key")
    return items.dedup_links(found.select("key.*", "pos", "text", "href")).drop("pos")


@query("dedup_report", f"""with a as (({TEXT_ITEMS}) union all ({ITEMS})), k as ({_FIRST})
select a.job_id, a.url_seq::bigint as url_seq, a.items, coalesce(k.kept, 0)::bigint as kept, (a.items - coalesce(k.kept, 0))::bigint as skipped
from (select job_id, url_seq, count(*)::bigint as items from a group by job_id, url_seq) a
left join (select job_id, url_seq, count(*) as kept from k group by job_id, url_seq) k on k.job_id = a.job_id and k.url_seq = a.url_seq""")
def _dedup_report(spark, sf):
    return items.dedup_report(_all_items(spark, sf))


_SAVED = "select d.lang as job_id, d.text as item from documents d join labels l on l.doc_id = d.doc_id"


@query("new_items", f"""select job_id, url_seq::bigint as url_seq, md5(item) as digest from ({_FIRST}) f where not exists (
 select 1 from ({_SAVED}) s where s.job_id = f.job_id and s.item = f.item)""")
def _new(spark, sf):
    saved = run_sql(spark, sf, _SAVED, "documents", "labels")
    return items.new_items(_all_items(spark, sf), saved).select("job_id", "url_seq", F.md5("item").alias("digest"))


# no page of the jobs in English found one
_CACHE = "select lang as job_id, doc_id as seq, case when lang <> 'en' then concat('li.', source) end as selector from documents"


@query("job_result", f"""with r as (select *, row_number() over (partition by job_id order by url_seq, pos) as n from (({TEXT_ITEMS}) union all ({ITEMS})) where item <> ''),
 k as (select job_id, arg_min(selector, seq) as selector from ({_CACHE}) group by job_id)
select r.job_id, count(*)::bigint as item_count, md5(string_agg(item, chr(10) order by n) filter (n <= 5)) as preview_digest, max(k.selector) as selector,
 case when max(k.selector) is null then 'text_only' else 'llm_selector' end as method from r left join k on k.job_id = r.job_id group by r.job_id""")
def _job_result(spark, sf):
    found = jobs.job_result(_all_items(spark, sf), run_sql(spark, sf, _CACHE, "documents"))
    return found.withColumn("preview_digest", F.md5("preview")).drop("preview")


# Output -----------------------------------------------------------------------------------------

def _all_jobs(spark, sf):
    """Items of all jobs and the texts as one more job, and their metadata."""
    found = _items(spark, sf).unionByName(_documents(spark, sf))
    return found, items.result_metadata(found, run_sql(spark, sf, _TWO_JOBS, "region"), RUN_AT)


def _two_fields(spark, sf):
    """Items of all jobs, what they give in the fields name and url, and their metadata."""
    found, meta = _all_jobs(spark, sf)
    shown = items.with_placeholder(found, meta).drop("placeholder")
    return shown, items.records_wide(found, ["name", "url"]), meta


def _stored(spark, df, name):
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


_TWO_JOBS = f"""{JOB_METADATA} union all select 'texts', 'https://shop.example.com/texts', 'li.text', 'llm_selector' from region where r_regionkey = 0"""
_DOCUMENTS = "select 'texts' as job_id, doc_id as url_seq, 0 as pos, concat(source, chr(10), text) as item from documents"


def _documents(spark, sf):
    return run_sql(spark, sf, _DOCUMENTS, "documents")


_TWO_ITEMS = f"({ITEMS}) union all ({_DOCUMENTS})"
_RECORDS = f"""v as (select *, row_number() over (partition by job_id order by url_seq, pos) as n from ({_TWO_ITEMS})),
 rec as ({_sql_n3('select job_id, n, item from v', ['name', 'url'])}),
 meta as (select j.job_id, j.url, '{RUN_AT}' as timestamp, coalesce(c.n, 0)::bigint as item_count, j.selector, j.method,
  case when j.method = 'llm_selector' then 'high' else 'low' end as confidence from ({_TWO_JOBS}) j left join (select job_id, count(*) as n from v group by job_id) c on c.job_id = j.job_id)"""


@query("write_json", f"""with {_RECORDS} select job_id, n::bigint as line_no, concat(case when n > 1 then ', ' else '  ' end, '{{"name":', to_json(name)::varchar, ',"url":', to_json(url)::varchar, '}}') as line from rec
 union all select job_id, 0, '{{"data": [' from meta
 union all select job_id, item_count + 1, concat('], "metadata": {{"url":"', url, '","timestamp":"', timestamp, '","item_count":', item_count, ',"selector":', case when selector is null then 'null' else concat('"', selector, '"') end,
  ',"method":"', method, '","confidence":"', confidence, '"}}}}') from meta""")
def _json(spark, sf):
    _, records, meta = _two_fields(spark, sf)
    return sinks.to_json_lines(records, ["name", "url"], meta)


def _csv_cell(x: str) -> str:
    return f"case when regexp_matches({x}, '[,\"\\n\\r]') then concat('\"', replace({x}, '\"', '\"\"'), '\"') else {x} end"


@query("write_csv", f"""with {_RECORDS} select job_id, n::bigint as line_no, concat({_csv_cell('name')}, ',', {_csv_cell('url')}) as line from rec
 union all select job_id, 0, 'name,url' from meta where item_count > 0 union all select job_id, item_count + 1, '' from meta where item_count > 0
 union all select job_id, item_count + 2, concat('# url=', url, ',items=', item_count, ',method=', method) from meta where item_count > 0""")
def _csv(spark, sf):
    _, records, meta = _two_fields(spark, sf)
    return sinks.to_csv_lines(records, ["name", "url"], meta)


_CELL = "replace({}, '|', '\\|')"


@query("to_markdown", f"""with {_RECORDS} select job_id, (n + 3)::bigint as line_no, concat('| ', {_CELL.format('name')}, ' | ', {_CELL.format('url')}, ' |') as line from rec
 union all select job_id, 2, '| name | url |' from meta where item_count > 0 union all select job_id, 3, '| --- | --- |' from meta where item_count > 0
 union all select job_id, 1, '' from meta where item_count > 0 union all select job_id, 0, '_No data extracted._' from meta where item_count = 0
 union all select job_id, 0, concat('**Source:** ', url, '  |  **Items:** ', item_count, '  |  **Method:** ', method) from meta where item_count > 0""")
def _markdown(spark, sf):
    _, records, meta = _two_fields(spark, sf)
    return sinks.to_markdown_lines(records, ["name", "url"], meta)


_TEXT_LINES = f"""with {_RECORDS} select r.job_id, (n + 3)::bigint as line_no, case when m.method = 'llm_selector' then concat(n, '. ', item) else item end as line from rec r join meta m on m.job_id = r.job_id
 union all select job_id, 0, concat('# Source: ', url) from meta union all select job_id, 1, concat('# Extracted: ', timestamp) from meta
 union all select job_id, 2, concat('# Items: ', item_count, '  Method: ', method) from meta union all select job_id, 3, '' from meta
 union all select job_id, 4, 'No data extracted.' from meta where item_count = 0"""


@query("to_text", _TEXT_LINES)
def _text(spark, sf):
    found, _, meta = _two_fields(spark, sf)
    return sinks.to_text_lines(found, meta)


@query("format_result", _TEXT_LINES)
def _format_result(spark, sf):
    found, records, meta = _two_fields(spark, sf)
    return sinks.format_result(found, records, ["name", "url"], meta, "yaml")


_FORMATS = {"json": "write_json", "csv": "write_csv", "MD ": "to_markdown", "txt": "to_text"}


@query("format_result_each", " union all ".join(f"select '{fmt}' as fmt, job_id, line_no, line from ({ORACLES[name]})" for fmt, name in _FORMATS.items()))
def _format_result_each(spark, sf):
    """The documents of all jobs in each format: counted, numbered and shaped once for all formats."""
    found, meta = _all_jobs(spark, sf)
    meta = _stored(spark, meta, "meta")
    # shaped where the items lie: numbering deals rows evenly, so few of its parts hold the long texts
    kept = items.with_placeholder(found, meta).withColumn("whole", F.col("item"))
    shaped = _stored(spark, items.records_wide(kept, ["name", "url"]), "shaped")
    numbered = sinks.number_items(shaped)
    found = numbered.withColumnRenamed("whole", "item").drop("placeholder", "name", "url")
    records = numbered.where(~F.col("placeholder")).drop("placeholder", "whole")
    each = [sinks.format_result(found, records, ["name", "url"], meta, fmt).select(F.lit(fmt).alias("fmt"), "*") for fmt in _FORMATS]
    return reduce(DataFrame.unionByName, each)


@query("write_documents", f"select job_id, line from ({ORACLES['write_json']})")
def _write_documents(spark, sf):
    """JSON documents of all jobs written as files and read back."""
    _, records, meta = _two_fields(spark, sf)
    path = scratch_path(spark, "documents")
    documents.write_documents(sinks.to_json_lines(records, ["name", "url"], meta), path, ".json")
    return spark.read.text(path).select("job_id", F.col("value").alias("line"))


@query("snapshot_pages", """select page_id as job_id, concat(page_id, '_', trim(substr(regexp_replace(url, '[^\\p{L}\\p{N}_]', '_', 'g'), 1, 50), '_'), '_', substr(sha256(url), 1, 16)) as file_key, length(html)::bigint as raw_chars from pages""")
def _snapshot(spark, sf):
    source = pages(spark, sf).select(F.col("page_id").alias("job_id"), "url", "html")
    path = scratch_path(spark, "snapshots")
    sinks.snapshot_pages(source, path)
    return spark.read.parquet(path).where("clean_html like '<body>%</body>'").select(
        "job_id", "file_key", F.length("raw_html").alias("raw_chars"))


@query("append_prompt_log", """select '2026-01-01' as day, count(*)::bigint as entries, sum(length(text))::bigint as chars from (select distinct text from documents)""")
def _prompt_log(spark, sf):
    docs = table(spark, sf, "documents").select("text").distinct().withColumn("prompt_id", F.sha2("text", 256))
    path = scratch_path(spark, "prompt-log")
    sinks.append_prompt_log(docs.withColumnRenamed("text", "prompt"),
                            docs.select("prompt_id", F.lit("{}").alias("raw")), path, "m", RUN_AT)
    return spark.read.parquet(path).groupBy(F.col("date").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("entries"), F.sum(F.length("prompt")).alias("chars"))


# Streams ----------------------------------------------------------------------------------------

def _drained(spark, stream, name, mode="append"):
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    streams.drain(stream, path, checkpoint, mode)
    return spark.read.parquet(path)


@query("stream_links", f"select page_id, pos, text, href from ({DISTINCT_LINKS_SQL})")
def _stream_links(spark, sf):
    source = streams.stream_table(spark, sf, "pages")
    return _drained(spark, streams.stream_links(source), "stream-links")


@query("stream_items", MENU_ITEMS_SQL)
def _stream_items(spark, sf):
    source = streams.stream_table(spark, sf, "pages")
    return _drained(spark, streams.stream_items(source, "nav a"), "stream-items")


@query("stream_dedup", "select distinct lang as job_id, md5(text) as digest from documents")
def _stream_dedup(spark, sf):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])
    docs = streams.stream_table(spark, sf, "documents", schema)
    # a document a second; repeats lie within the delay, after which their keys are forgotten
    timed = docs.select(F.col("lang").alias("job_id"), F.col("text").alias("item"), F.timestamp_seconds("doc_id").alias("seen_at"))
    kept = streams.stream_dedup(timed, "seen_at", "3650 days")
    return _drained(spark, kept, "stream-dedup").select("job_id", F.md5("item").alias("digest"))


@query("stream_job_state", """select user_id as job_id, event_type as url, arg_max(case when value > 50 then 'failed' else 'processed' end, event_id) as state
 from events group by user_id, event_type""")
def _stream_state(spark, sf):
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
                           T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
    events = streams.stream_table(spark, sf, "events", schema)
    outcomes = events.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("url"),
                             F.when(F.col("value") > 50, "failed").otherwise("processed").alias("state"), F.col("event_id").alias("seq"))
    states = _drained(spark, streams.stream_job_state(outcomes), "stream-state", "update")
    return states.groupBy("job_id", "url").agg(F.max_by("state", "batch_id").alias("state"))


# Every page is queued by its site's job, some twice; a third has no outcome yet, some have both, and some URLs were never listed.
_JOB_EVENTS = """select regexp_extract(url, '^([a-z]+://[^/]*)', 1) as job_id, url, event, page_id from (
 select url, page_id, 'queued' as event from pages union all select url, page_id, 'queued' from pages where page_id % 5 = 0
 union all select url, page_id, case when page_id % 4 = 0 then 'failed' else 'done' end from pages where page_id % 3 > 0
 union all select url, page_id, 'done' from pages where page_id % 8 = 0
 union all select concat(url, '/late'), page_id, 'failed' from pages where page_id % 6 = 0) t"""


@query("stream_job_machine", f"""with e as ({_JOB_EVENTS}),
 m as (select distinct job_id, url, case event when 'queued' then 'pending' when 'done' then 'processed' else 'failed' end as state from e),
 s as (select * from m where state <> 'pending' or not exists (select 1 from m o where o.job_id = m.job_id and o.url = m.url and o.state <> 'pending')),
 j as (select job_id, case when count(*) filter (state = 'pending') > 0 then 'running' when count(*) filter (state = 'failed') > 0 then 'partial' else 'complete' end as status from s group by job_id)
select s.job_id, s.url, s.state, j.status from s join j on j.job_id = s.job_id""")
def _stream_job_machine(spark, sf):
    """Events in several micro-batches, outcomes before and after their queueing, with a restart in between."""
    events = run_sql(spark, sf, _JOB_EVENTS, "pages")
    source, out, state = (scratch_path(spark, f"job-{n}") for n in ("events", "changes", "state"))
    for half in (0, 1):
        part = events.where(F.pmod(F.xxhash64("url", "event"), F.lit(2)) == half).drop("page_id")
        part.repartition(3, "url").write.mode("append").parquet(source)
        stream = streams.stream_pages(spark, source, events.drop("page_id").schema, files_per_batch=2)
        streams.drain(job_state.stream_job_changes(stream, shards=4), out, state)
    changes = spark.read.parquet(out)
    return job_state.url_states(changes).join(job_state.job_states(changes).select("job_id", "status"), "job_id")

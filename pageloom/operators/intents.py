"""From request rows to intent rows.

``requests(request_id, query)``, ``responses(prompt_id, raw)``; an intent row has the columns of
INTENT_FIELDS. Rows without a URL stay, with ``error`` set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.constants import (
    DEFAULT_DEPTH, NO_CAP, NO_URL_ERROR,
)
from pageloom.functions import requests as rules
from pageloom.functions.replies import decode_response, reply_bool, reply_int, reply_string
from pageloom.functions.text import empty_to_null, strip
from pageloom.functions.urls import extract_url, normalise_url

INTENT_FIELDS = [
    "url", "intent_type", "content_target", "max_urls", "depth", "output_format", "output_file",
    "paginate", "max_pages",
]

PROMPT_HEAD = """Read the request and describe the extraction it asks for.
intent_type is url_list for links, page_content for the text of one page, structured_data for named
fields, deep_content for the pages linked from a page. output_format, output_file and max_pages stay
null unless the request names them; paginate is true when it asks for several result pages.
Answer with one JSON object holding url, intent_type, content_target, max_urls, depth,
output_format, output_file, paginate and max_pages, and nothing else.
Request: """


def intent_prompt(query: Column) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), query)


def build_intent_prompts(requests: DataFrame) -> DataFrame:
    """request_id, prompt_id, prompt. Equal requests share a prompt_id, so a distinct over
    (prompt_id, prompt) is what has to be answered."""
    prompt = intent_prompt(F.col("query"))
    return requests.select("request_id", F.sha2(prompt, 256).alias("prompt_id"), prompt.alias("prompt"))


def heuristic_intents(requests: DataFrame) -> DataFrame:
    """Intents from the wording alone."""
    q = F.col("query")
    found = requests.select("request_id", "query", extract_url(q).alias("raw_url"),
                            rules.classify_intent(q).alias("intent_type"))
    url = F.col("raw_url")
    return found.select(
        "request_id", normalise_url(url).alias("url"), "intent_type",
        rules.content_target(q, url).alias("content_target"),
        F.lit(NO_CAP).alias("max_urls"),
        rules.intent_depth(F.col("intent_type")).alias("depth"),
        rules.output_format_hint(q).alias("output_format"),
        rules.output_file_hint(q, url).alias("output_file"),
        rules.pagination_wanted(q).alias("paginate"),
        rules.pagination_pages(q).alias("max_pages"),
        F.when(url.isNull(), NO_URL_ERROR).alias("error"))


def _or_default(value: Column, default: int | None) -> Column:
    """A missing or zero number becomes the default."""
    return F.coalesce(F.nullif(value, F.lit(0)), F.lit(default).cast("int"))


def parse_intent_response(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Intents from model replies; a reply that cannot be used is a row with ``error``."""
    joined = requests.withColumn("prompt_id", F.sha2(intent_prompt(F.col("query")), 256)) \
        .join(responses.select("prompt_id", "raw"), "prompt_id", "left")
    reply = joined.select("request_id", "query", decode_response(F.col("raw")).alias("d"))
    d, q = F.col("d"), F.col("query")
    read = reply.select(
        "request_id", "query", "d",
        F.coalesce(empty_to_null(reply_string(d, "$.url")), extract_url(q)).alias("raw_url"),
        rules.valid_intent_type(F.coalesce(reply_string(d, "$.intent_type"), F.lit("page_content")))
        .alias("intent_type"),
        strip(F.coalesce(reply_string(d, "$.content_target"), F.lit(""))).alias("target"))
    url, kind = F.col("raw_url"), F.col("intent_type")
    from_query = (F.col("target") == "") & kind.isin("structured_data", "deep_content")
    error = F.when(d.isNull(), "The reply is not JSON.").when(url.isNull(), NO_URL_ERROR)
    return read.select(
        "request_id", normalise_url(url).alias("url"), "intent_type",
        F.when(from_query, rules.content_target(q, url)).otherwise(F.col("target")).alias("content_target"),
        F.coalesce(reply_int(d, "$.max_urls"), F.lit(NO_CAP)).alias("max_urls"),
        rules.intent_depth(kind, reply_int(d, "$.depth")).alias("depth"),
        rules.valid_format(reply_string(d, "$.output_format")).alias("output_format"),
        empty_to_null(reply_string(d, "$.output_file")).alias("output_file"),
        reply_bool(d, "$.paginate").alias("paginate"),
        _or_default(reply_int(d, "$.max_pages"), None).alias("max_pages"),
        error.alias("error"))


def resolve_intents(requests: DataFrame, primary: DataFrame | None = None,
                    secondary: DataFrame | None = None) -> DataFrame:
    """First usable source per request: primary replies, secondary replies, wording.

    ``source`` names the one used. A request without any URL is an error row.
    """
    packed = F.struct(*INTENT_FIELDS)
    result = heuristic_intents(requests).select("request_id", packed.alias("wording"), "error")
    picks = []
    for name, responses in (("primary", primary), ("secondary", secondary)):
        if responses is None:
            continue
        parsed = parse_intent_response(requests, responses).where(F.col("error").isNull())
        result = result.join(parsed.select("request_id", packed.alias(name)), "request_id", "left")
        picks.append(name)
    picked = F.coalesce(*[F.col(p) for p in picks], F.col("wording"))
    source = F.lit("wording")
    for name in reversed(picks):
        source = F.when(F.col(name).isNotNull(), name).otherwise(source)
    chosen = result.select("request_id", picked.alias("i"), source.alias("source"), "error")
    return chosen.select(
        "request_id", "i.*", "source",
        F.when(F.col("source") == "wording", F.col("error")).alias("error"))


def explicit_intents(given: DataFrame) -> DataFrame:
    """Intents for explicit addresses: request_id, url and optional target, max_urls, depth."""
    optional = lambda name, kind: (F.col(name) if name in given.columns else F.lit(None)).cast(kind)
    target = F.coalesce(optional("target", "string"), F.lit(""))
    return given.select(
        "request_id", "url",
        F.when(target != "", "structured_data").otherwise("page_content").alias("intent_type"),
        target.alias("content_target"),
        F.coalesce(optional("max_urls", "int"), F.lit(NO_CAP)).alias("max_urls"),
        F.coalesce(optional("depth", "int"), F.lit(DEFAULT_DEPTH)).alias("depth"),
        F.lit(None).cast("string").alias("output_format"), F.lit(None).cast("string").alias("output_file"),
        F.lit(False).alias("paginate"), F.lit(None).cast("int").alias("max_pages"))


def apply_overrides(intents: DataFrame, overrides: DataFrame) -> DataFrame:
    """Intents of requests with the caller's settings on top.

    ``overrides(request_id, max_urls, depth, target, format, output, paginate, max_pages)``, every
    value nullable. Adds the effective ``format``, ``output``, ``paginate`` and ``max_pages`` (null: all).
    """
    o = overrides.select("request_id", F.struct(
        "max_urls", "depth", "target", "format", "output", "paginate", "max_pages").alias("o"))
    joined = intents.join(o, "request_id", "left")
    fmt = F.coalesce("o.format", F.lit("json"))
    takes_file = F.col("o.output").isNull() & F.col("output_file").isNotNull()
    no_file = F.col("o.output").isNotNull() | F.col("output_file").isNull()
    effective = (
        F.when(takes_file, F.coalesce("output_format", fmt))
        .when(no_file & F.col("output_format").isNotNull() & (fmt == "json"), F.col("output_format"))
        .otherwise(fmt))
    return joined.select(
        "request_id", "url", "intent_type",
        F.coalesce(empty_to_null(F.col("o.target")), F.col("content_target")).alias("content_target"),
        F.coalesce("o.max_urls", "max_urls").alias("max_urls"),
        F.coalesce("o.depth", "depth").alias("depth"),
        effective.alias("format"),
        F.coalesce("o.output", "output_file").alias("output"),
        (F.coalesce("o.paginate", F.lit(False)) | F.coalesce("paginate", F.lit(False))).alias("paginate"),
        F.coalesce(F.nullif(F.col("o.max_pages"), F.lit(0)), F.col("max_pages")).alias("max_pages"))


def plan_report(intents: DataFrame) -> DataFrame:
    """What would run, without running it: request_id and a JSON line with job and intent."""
    intent = F.struct("url", "intent_type", "content_target", "max_urls", "depth")
    return intents.select("request_id", F.to_json(
        F.struct(F.concat(F.lit("job_"), F.col("request_id").cast("string")).alias("job_id"), intent.alias("intent")),
        {"ignoreNullFields": "false"}).alias("plan"))

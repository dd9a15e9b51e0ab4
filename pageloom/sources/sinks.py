"""Rendered output as numbered lines, and writers.

Documents are tables of ``(job_id, line_no, line)``: a job's document is its lines in order, so a
job of any size is rendered and written by many tasks and never gathered into one cell. Numbering and
counting read the items more than once: pass a stored table, not a plan that still has to parse pages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.constants import NO_DATA_MARKDOWN
from pageloom.functions.urls import url_slug
from pageloom.operators.clean import clean_pages, render_html
from pageloom.operators.html import parse_pages
from pageloom.operators.ranking import number_rows

_KEEP_NULLS = {"ignoreNullFields": "false"}
#: The column by which rows tell that ``number_items`` has numbered them.
_NUMBER = "_n"


def number_items(items: DataFrame) -> DataFrame:
    """Items (job_id, url_seq, pos, …) numbered once for several formats, which then don't number them again.

    Records made of numbered items have the same numbers; give both to each format.
    """
    return number_rows(items, ["job_id"], "url_seq", ["pos"], name=_NUMBER)


def _numbered(records: DataFrame) -> DataFrame:
    """Records (job_id, url_seq, pos, …) with ``n`` from 1 per job."""
    numbered = records if _NUMBER in records.columns else number_items(records)
    return numbered.withColumn("n", F.col(_NUMBER)).drop(_NUMBER)


def _lines(df: DataFrame, line_no: Column, line: Column) -> DataFrame:
    return df.select("job_id", line_no.cast("bigint").alias("line_no"), line.alias("line"))


def to_json_lines(records: DataFrame, fields: Sequence[str], meta: DataFrame,
                  include_metadata: bool = True) -> DataFrame:
    """``{"data": […], "metadata": {…}}`` per job, one item per line.

    ``records`` has one column per field, ``meta`` is the result of ``result_metadata``.
    """
    item = F.to_json(F.struct(*fields), _KEEP_NULLS)
    body = _lines(_numbered(records), F.col("n"), F.concat(F.when(F.col("n") > 1, ", ").otherwise("  "), item))
    head = _lines(meta, F.lit(0), F.lit('{"data": ['))
    described = F.to_json(F.struct("url", "timestamp", "item_count", "selector", "method", "confidence"), _KEEP_NULLS)
    tail = F.concat(F.lit('], "metadata": '), described, F.lit("}")) if include_metadata else F.lit("]}")
    return head.unionByName(body).unionByName(_lines(meta, F.col("item_count") + 1, tail))


def _csv_cell(cell: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(cell.rlike('[,"\\n\\r]'), quoted).otherwise(cell)


def csv_row(fields: Sequence[str]) -> Column:
    """One CSV line: minimal quoting, doubled quotes. ``to_csv`` would also quote a leading ``#``."""
    line = F.concat_ws(",", *[_csv_cell(F.coalesce(f, F.lit(""))) for f in fields])
    return F.when(line == "", '""').otherwise(line) if len(fields) == 1 else line


def to_csv_lines(records: DataFrame, fields: Sequence[str], meta: DataFrame,
                 include_metadata: bool = True) -> DataFrame:
    """Header, rows and a comment line per job; a job without items has no lines."""
    filled = meta.where(F.col("item_count") > 0)
    header = F.concat_ws(",", *[_csv_cell(F.lit(f)) for f in fields])
    out = _lines(filled, F.lit(0), header).unionByName(
        _lines(_numbered(records), F.col("n"), csv_row(fields)))
    if include_metadata:
        note = F.format_string("# url=%s,items=%d,method=%s", "url", "item_count", "method")
        out = out.unionByName(_lines(filled, F.col("item_count") + 1, F.lit(""))) \
            .unionByName(_lines(filled, F.col("item_count") + 2, note))
    return out


def markdown_row(fields: Sequence[str]) -> Column:
    """One table row: bars escaped, cells whole."""
    cells = [F.replace(F.coalesce(f, F.lit("")), F.lit("|"), F.lit("\\|")) for f in fields]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def to_markdown_lines(records: DataFrame, fields: Sequence[str], meta: DataFrame,
                      include_metadata: bool = True) -> DataFrame:
    """Source line, header, separator and one row per item; a fixed line for a job without."""
    filled = meta.where(F.col("item_count") > 0)
    out = _lines(filled, F.lit(2), F.lit("| " + " | ".join(fields) + " |")) \
        .unionByName(_lines(filled, F.lit(3), F.lit("| " + " | ".join("---" for _ in fields) + " |"))) \
        .unionByName(_lines(_numbered(records), F.col("n") + 3, markdown_row(fields))) \
        .unionByName(_lines(meta.where(F.col("item_count") == 0), F.lit(0), F.lit(NO_DATA_MARKDOWN)))
    if include_metadata:
        source = F.format_string("**Source:** %s  |  **Items:** %d  |  **Method:** %s", "url", "item_count", "method")
        out = out.unionByName(_lines(filled, F.lit(0), source)).unionByName(_lines(filled, F.lit(1), F.lit("")))
    return out


def to_text_lines(items: DataFrame, meta: DataFrame, include_metadata: bool = True) -> DataFrame:
    """``N. item`` per item for selector jobs, the text as it is for text jobs."""
    methods = meta.select("job_id", "method")
    numbered = _numbered(items).join(methods, "job_id")
    line = F.when(F.col("method") == "llm_selector", F.concat(F.col("n").cast("string"), F.lit(". "), "item")) \
        .otherwise(F.col("item"))
    out = _lines(numbered, F.col("n") + 3, line)
    if include_metadata:
        heads = [F.concat(F.lit("# Source: "), "url"), F.concat(F.lit("# Extracted: "), "timestamp"),
                 F.format_string("# Items: %d  Method: %s", "item_count", "method"), F.lit("")]
        for i, head in enumerate(heads):
            out = out.unionByName(_lines(meta, F.lit(i), head))
    return out


def format_result(items: DataFrame, records: DataFrame, fields: Sequence[str], meta: DataFrame,
                  fmt: str = "json", include_metadata: bool = True) -> DataFrame:
    """Lines in the asked format; ``markdown`` is ``md``, anything unknown is text."""
    fmt = fmt.lower().strip()
    writers = {"json": to_json_lines, "csv": to_csv_lines, "md": to_markdown_lines, "markdown": to_markdown_lines}
    if fmt in writers:
        return writers[fmt](records, fields, meta, include_metadata)
    return to_text_lines(items, meta, include_metadata)


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write documents as text, one folder per job; file order is line order.

    Range partitioning splits a large job over many files instead of one task.
    """
    ordered = lines.repartitionByRange("job_id", "line_no").sortWithinPartitions("job_id", "line_no")
    ordered.select("job_id", "line").write.mode(mode).partitionBy("job_id").text(path)


def snapshot_rows(pages: DataFrame) -> DataFrame:
    """pages(job_id, url, html) with file key, raw and cleaned HTML."""
    kept = pages.select("job_id", "url", "html", F.col("html").alias("raw_html"))
    cleaned = render_html(clean_pages(parse_pages(kept)))
    return cleaned.select(
        "job_id", "url", F.concat_ws("_", "job_id", url_slug(F.col("url"))).alias("file_key"),
        "raw_html", F.col("html").alias("clean_html"))


def snapshot_pages(pages: DataFrame, path: str, mode: str = "append") -> None:
    """Write raw and cleaned HTML for inspection."""
    snapshot_rows(pages).write.mode(mode).parquet(path)


def prompt_log_rows(prompts: DataFrame, responses: DataFrame, model: str, run_at: str) -> DataFrame:
    """Audit rows of answered prompts: date, timestamp, model, prompt, response."""
    stamp = F.to_timestamp(F.lit(run_at))
    return prompts.select("prompt_id", "prompt").join(responses.select("prompt_id", "raw"), "prompt_id").select(
        F.to_date(stamp).alias("date"), stamp.alias("timestamp"), F.lit(model).alias("model"),
        "prompt_id", "prompt", F.col("raw").alias("response"))


def append_prompt_log(prompts: DataFrame, responses: DataFrame, path: str, model: str, run_at: str) -> None:
    """Append to the audit trail, one folder per day."""
    prompt_log_rows(prompts, responses, model, run_at).write.mode("append").partitionBy("date").parquet(path)

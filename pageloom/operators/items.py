"""Item rows to records, without repeats.

``items(job_id, url_seq, pos, item)``: items of a job in page order and, on a page, by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.constants import NO_DATA_ITEM
from pageloom.functions.items import normalise_map, normalise_values
from pageloom.functions.text import nth


def item_key(item: Column) -> Column:
    """What makes two items the same: a digest of the whole item, 32 bytes however long it is."""
    return F.unhex(F.sha2(item, 256))


def normalise_items(items: DataFrame, fields: Column | Sequence[str]) -> DataFrame:
    """Items with ``record MAP<field, value>``; ``fields`` may be a column."""
    return items.withColumn("record", normalise_map(F.col("item"), fields))


def records_wide(items: DataFrame, fields: Sequence[str]) -> DataFrame:
    """N3 with one given schema: one column per field instead of ``item``."""
    key = [c for c in items.columns if c != "item"]
    names = list(dict.fromkeys(fields))
    packed = items.select(*key, normalise_values(F.col("item"), names).alias("_v"))
    return packed.select(*key, *[nth(F.col("_v"), F.lit(i)).alias(n) for i, n in enumerate(names)])


def links_display(links: DataFrame) -> DataFrame:
    """A display line per link next to its real columns."""
    return links.withColumn("item", F.concat_ws(" → ", "text", "href"))


def result_metadata(items: DataFrame, jobs: DataFrame, run_at: str) -> DataFrame:
    """Per job of jobs(job_id, url, selector, method): item count, confidence, run time.

    Counts real items, so a job without any has 0.
    """
    counts = items.groupBy("job_id").agg(F.count("item").alias("item_count"))
    return jobs.select("job_id", "url", "selector", "method").join(counts, "job_id", "left").select(
        "job_id", "url", F.lit(run_at).alias("timestamp"),
        F.coalesce("item_count", F.lit(0)).cast("bigint").alias("item_count"), "selector", "method",
        F.when(F.col("method") == "llm_selector", "high").otherwise("low").alias("confidence"))


def with_placeholder(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """A job without items gets one placeholder item, at page 0 and position 0.

    Only job ids are joined; the items themselves are passed on where they are.
    """
    missing = jobs.select("job_id").distinct().join(items.select("job_id").distinct(), "job_id", "left_anti")
    place = [F.lit(0).cast(kind).alias(name) for name, kind in items.dtypes if name in ("url_seq", "pos")]
    placeholders = missing.select("job_id", *place, F.lit(NO_DATA_ITEM).alias("item"), F.lit(True).alias("placeholder"))
    return items.withColumn("placeholder", F.lit(False)).unionByName(placeholders, allowMissingColumns=True)


def _first_items(items: DataFrame) -> DataFrame:
    order = ["url_seq", "pos"]
    rest = [c for c in items.columns if c not in ("job_id", *order)]
    first = F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_first")
    return items.groupBy("job_id", item_key(F.col("item")).alias("_key")).agg(first)


def dedup_items(items: DataFrame) -> DataFrame:
    """The first item of every key of a job, over all its pages.

    An aggregate, not a window: repeats are dropped before the shuffle, so an item that makes up a
    third of all rows costs one row per task.
    """
    return _first_items(items).select("job_id", "_first.*")


def dedup_links(links: DataFrame) -> DataFrame:
    """J1 for links(job_id, url_seq, pos, text, href): first row of every (text, href) of a job."""
    order = F.struct("url_seq", "pos")
    return links.groupBy("job_id", "text", "href").agg(F.min(order).alias("_first")).select(
        "job_id", "_first.*", "text", "href")


def dedup_report(items: DataFrame) -> DataFrame:
    """Items seen, kept and skipped per page of a job.

    First rows per key are counted where they occur; both sides are small aggregates.
    """
    seen = items.groupBy("job_id", "url_seq").agg(F.count(F.lit(1)).alias("items"))
    firsts = items.groupBy("job_id", item_key(F.col("item")).alias("_key")).agg(
        F.min("url_seq").alias("url_seq"))
    kept = firsts.groupBy("job_id", "url_seq").agg(F.count(F.lit(1)).alias("kept"))
    return seen.join(kept, ["job_id", "url_seq"], "left").select(
        "job_id", "url_seq", "items", F.coalesce("kept", F.lit(0)).alias("kept"),
        (F.col("items") - F.coalesce("kept", F.lit(0))).alias("skipped"))


def new_items(items: DataFrame, saved: DataFrame) -> DataFrame:
    """Items of this run that an earlier run of the job has not saved, repeats dropped.

    Repeats go first, so the anti join sees one row per key on both sides and keeps the
    partitioning of the two aggregates.
    """
    known = saved.select("job_id", item_key(F.col("item")).alias("_key")).distinct()
    return _first_items(items).join(known, ["job_id", "_key"], "left_anti").select("job_id", "_first.*")

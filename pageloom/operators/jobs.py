"""Job state and job documents as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pageloom.constants import PREVIEW_ITEMS
from pageloom.operators.crawl import crawl_summary


def mark_urls(state: DataFrame, outcomes: DataFrame) -> DataFrame:
    """state(job_id, url, state) after outcomes(job_id, url, outcome done / failed).

    A done URL is processed and a failed one failed, each once; an outcome for an unlisted URL adds
    it. Repeated outcomes collapse before the join; a URL with both keeps both marks, as in a job
    that failed on it first and reached it later.
    """
    marks = outcomes.select(
        "job_id", "url", F.when(F.col("outcome") == "failed", "failed").otherwise("processed").alias("state")
    ).distinct()
    decided = marks.select("job_id", "url").distinct()
    open_urls = state.where(F.col("state") == "pending").join(decided, ["job_id", "url"], "left_anti")
    settled = state.where(F.col("state") != "pending").select("job_id", "url", "state")
    return open_urls.select("job_id", "url", "state").unionByName(settled.unionByName(marks).distinct())


def job_status(state: DataFrame) -> DataFrame:
    """Complete / partial once nothing is pending, running before."""
    return crawl_summary(state).select(
        "job_id", F.when(F.col("pending") > 0, "running")
        .when(F.col("failed") > 0, "partial").otherwise("complete").alias("status"))


def saved_links(jobs: DataFrame) -> DataFrame:
    """Link rows of saved job documents."""
    return jobs.select("job_id", F.posexplode("results").alias("url_seq", "r")) \
        .where(F.col("r.links").isNotNull()) \
        .select("job_id", "url_seq", F.col("r.url").alias("url"), F.posexplode("r.links").alias("pos", "l")) \
        .select("job_id", "url_seq", "url", "pos", "l.text", "l.href")


def saved_items(jobs: DataFrame) -> DataFrame:
    """Item rows of saved job documents (entries that hold links have none)."""
    return jobs.select("job_id", F.posexplode("results").alias("url_seq", "r")) \
        .where(F.col("r.links").isNull() & F.col("r.items").isNotNull()) \
        .select("job_id", "url_seq", F.col("r.url").alias("url"), F.posexplode("r.items").alias("pos", "item"))


def saved_selectors(jobs: DataFrame) -> DataFrame:
    """Selector cache rows: those stored with the job, then those of its results."""
    stored = jobs.select("job_id", F.posexplode(F.map_entries("selector_cache")).alias("seq", "e")) \
        .select("job_id", "seq", F.col("e.key").alias("url"), F.col("e.value").alias("selector"))
    found = jobs.select("job_id", F.size(F.map_keys("selector_cache")).alias("n"),
                        F.posexplode("results").alias("at", "r")) \
        .where((F.col("r.selector") != "") & (F.col("r.url") != "")
               & F.col("r.links").isNull() & F.col("r.items").isNotNull()) \
        .select("job_id", (F.col("at") + F.greatest("n", F.lit(0))).alias("seq"),
                F.col("r.url").alias("url"), F.col("r.selector").alias("selector"))
    # a later entry for a URL replaces the selector but keeps the place of the first
    return stored.unionByName(found).groupBy("job_id", "url").agg(
        F.min("seq").alias("seq"), F.max_by("selector", "seq").alias("selector"))


def list_jobs(jobs: DataFrame, limit: int = 20) -> DataFrame:
    """Newest jobs first; ids sort by creation time."""
    return jobs.select(
        "job_id", "status", "query", "created_at",
        F.greatest(F.size("urls_processed"), F.lit(0)).alias("urls_processed"),
        F.greatest(F.size("urls_pending"), F.lit(0)).alias("urls_pending"),
    ).orderBy(F.desc("job_id")).limit(limit)


def inspect_job(jobs: DataFrame, job_id: str) -> DataFrame:
    """One job at a glance."""
    count = lambda c: F.greatest(F.size(c), F.lit(0))
    return jobs.where(F.col("job_id") == job_id).select(
        "job_id", "status", "query", F.col("intent.url").alias("url"),
        F.col("intent.content_target").alias("content_target"),
        count("urls_processed").alias("processed"), count("urls_pending").alias("pending"),
        count("urls_failed").alias("failed"), count("results").alias("results"),
        "output_path", "output_format", "created_at", "updated_at")


def inspect_cache(jobs: DataFrame, job_id: str) -> DataFrame:
    """Selector cache of one job as rows."""
    return jobs.where(F.col("job_id") == job_id).select(F.explode("selector_cache").alias("url", "selector"))


def resumable(jobs: DataFrame) -> DataFrame:
    """Jobs worth resuming: not complete and with pending URLs."""
    return jobs.where((F.col("status") != "complete") & (F.size("urls_pending") > 0)) \
        .select("job_id", "status", F.size("urls_pending").alias("pending"))


def resume_frontier(jobs: DataFrame) -> DataFrame:
    """The pending URLs of resumable jobs in queue order; failed ones are not tried again."""
    return jobs.where(F.col("status") != "complete") \
        .select("job_id", F.posexplode("urls_pending").alias("url_seq", "url"))


def job_result(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Per job of items(job_id, url_seq, pos, item): count, first five items as preview, first
    cached selector and the method it implies. ``cache(job_id, seq, selector)``.

    Preview and count are two aggregates of bounded rows; no job's items are gathered.
    """
    order = Window.partitionBy("job_id").orderBy("url_seq", "pos")
    head = items.where(F.col("item") != "").withColumn("_n", F.row_number().over(order)) \
        .where(F.col("_n") <= PREVIEW_ITEMS)
    preview = head.groupBy("job_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_n", "item"))), lambda x: x["item"]), "\n").alias("preview"))
    counts = items.where(F.col("item") != "").groupBy("job_id").agg(F.count(F.lit(1)).alias("item_count"))
    first = cache.groupBy("job_id").agg(F.min_by("selector", "seq").alias("selector"))
    return counts.join(preview, "job_id").join(first, "job_id", "left").select(
        "job_id", "item_count", "preview", "selector",
        F.when(F.col("selector").isNotNull(), "llm_selector").otherwise("text_only").alias("method"))

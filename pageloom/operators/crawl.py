"""Scope rules and the bounded walk over a link table.

Tables: ``intents(job_id, url, intent_type, max_urls, depth)``, ``state(job_id, url, state, url_seq)``
with states pending / processed / failed, ``links(src, pos, href)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions.text import empty_to_null
from pageloom.functions.urls import same_domain
from pageloom.operators.ranking import first_k_per_key
from pageloom.session import use_checkpoint_dir


def should_follow(intent_type: Column, depth: Column) -> Column:
    """U8: the intent asks for linked pages."""
    return (depth > 0) & intent_type.isin("deep_content", "url_list")


def seed_frontier(intents: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The start URL of every job unless it is already pending or processed."""
    seeds = intents.select("job_id", "url").distinct()
    if state is not None:
        known = state.where(F.col("state").isin("pending", "processed"))
        seeds = seeds.join(known, ["job_id", "url"], "left_anti")
    return seeds.withColumn("state", F.lit("pending"))


def scope_filter(candidates: DataFrame, state: DataFrame, intents: DataFrame,
                 same_domain_only: bool = True) -> DataFrame:
    """candidates(job_id, url, seq) a job may queue, with their place among the new ones.

    Known URLs and repeats go first, then other hosts than the seed's, then everything beyond
    ``max_urls`` minus the pending count (0 means no cap; such rows have a null place). Failed URLs
    may be queued again, processed ones do not use up the cap.
    """
    fresh = (
        candidates.groupBy("job_id", "url").agg(F.min("seq").alias("seq"))
        .join(state.where(F.col("state").isin("pending", "processed")), ["job_id", "url"], "left_anti"))
    pending = state.where(F.col("state") == "pending").groupBy("job_id").agg(
        F.count_distinct("url").alias("pending"))
    rules = intents.select("job_id", F.col("url").alias("seed"), "max_urls").join(pending, "job_id", "left")
    allowed = fresh.join(rules, "job_id")
    if same_domain_only:
        allowed = allowed.where(same_domain(F.col("url"), F.col("seed")))
    room = F.col("max_urls") - F.coalesce("pending", F.lit(0))
    columns = ["job_id", "url", "seq"]
    capped = first_k_per_key(
        allowed.where((F.col("max_urls") != 0) & (room > 0)), ["job_id"], ["seq", "url"], room)
    free = allowed.where(F.coalesce("max_urls", F.lit(0)) == 0)
    return capped.select(*columns, F.col("rank").alias("place")).unionByName(
        free.select(*columns, F.lit(None).cast("int").alias("place")))


def enqueue_links(links: DataFrame, state: DataFrame, intents: DataFrame,
                  same_domain_only: bool = True) -> DataFrame:
    """State with the links(job_id, href, seq) that pass U6 appended as pending."""
    candidates = links.select("job_id", F.col("href").alias("url"), "seq").where(
        empty_to_null(F.col("url")).isNotNull())
    added = scope_filter(candidates, state, intents, same_domain_only)
    return state.select("job_id", "url", "state", F.lit(False).alias("added")).unionByName(
        added.select("job_id", "url", F.lit("pending").alias("state"), F.lit(True).alias("added")))


def added_counts(enqueued: DataFrame) -> DataFrame:
    """How many URLs each job gained."""
    return enqueued.groupBy("job_id").agg(F.count_if("added").alias("added"))


def crawl(links: DataFrame, intents: DataFrame, same_domain_only: bool = True,
          max_hops: int | None = None, state: DataFrame | None = None) -> DataFrame:
    """visits(job_id, url, hop, label, rank) of a breadth-first walk from each job's seed.

    A URL is visited once, at most ``depth`` hops away, at most ``max_urls`` per job in the order
    (hop, order of the linking page, link position). Within a job and hop ``label`` ascends in that
    order; ``rank`` is the place in the whole walk, null for uncapped jobs.

    ``state(job_id, url, hop, label, rank, state)`` is what an interrupted walk left (visits with a
    state, see ``walk_state``): the walk goes on from its pending URLs, knows all others, and its
    result is that of the walk without the break. Failed URLs are not tried again.

    ``links`` is read once per hop: pass a stored table; in buckets by ``src`` it is not shuffled
    either. One join wave per hop, over the newest visits only. Each wave is checkpointed to the
    shared folder: it feeds two inputs of the next one, and a lost executor must not replay the
    whole walk. Only depths and whether a wave is empty reach the driver.
    """
    spark = links.sparkSession
    use_checkpoint_dir(spark)
    rules = intents.select(
        "job_id", F.col("url").alias("seed"), F.coalesce("max_urls", F.lit(0)).alias("max_urls"),
        F.when(should_follow(F.col("intent_type"), F.col("depth")), F.col("depth"))
        .otherwise(0).alias("depth"))
    bounds = rules.agg(F.max("depth").alias("depth"), F.max(F.col("max_urls") == 0).alias("uncapped")).first()
    if max_hops is None:
        max_hops = bounds["depth"] or 0
    if state is None:
        visited = pending = rules.select(
            "job_id", F.col("seed").alias("url"), F.lit(0).alias("hop"), F.lit(0).cast("bigint").alias("label"),
            F.when(F.col("max_urls") > 0, 1).alias("rank"))
        first_hop, last_pending, behind = 0, 0, 0
    else:
        columns = ["job_id", "url", "hop", "label", "rank"]
        visited, pending = state.select(*columns), state.where(F.col("state") == "pending").select(*columns)
        known = pending.agg(F.min("hop"), F.max("hop")).first()
        if known[0] is None:
            return visited
        first_hop, last_pending = known
        behind = visited.agg(F.max("label")).first()[0] + 1  # new labels come after all old ones
    edges = links.select(F.col("src").alias("url"), F.col("pos").cast("int").alias("pos"), "href") \
        .where(F.col("href").isNotNull())
    frontier = pending.where(F.col("hop") == first_hop)
    for hop in range(first_hop + 1, max_hops + 1):
        # without a break the newest ranks are those of the frontier
        used = (frontier if state is None else visited).groupBy("job_id").agg(F.max("rank").alias("used"))
        reached = (
            frontier.join(rules.where(F.col("depth") >= hop), "job_id")
            .join(edges, "url")
            .select("job_id", "seed", "max_urls", F.col("href").alias("url"), F.struct("label", "pos").alias("at")))
        if same_domain_only:
            reached = reached.where(same_domain(F.col("url"), F.col("seed")))
        fresh = (
            reached.groupBy("job_id", "url", "max_urls").agg(F.min("at").alias("at"))
            .join(visited.select("job_id", "url"), ["job_id", "url"], "left_anti")
            .select("job_id", "url", "max_urls", "at.*"))
        capped = fresh.where(F.col("max_urls") > 0).join(used, "job_id")
        room = F.col("max_urls") - F.col("used")
        rank = (F.col("used") + F.col("place")).cast("int")
        wave = first_k_per_key(
            capped.where(room > 0), ["job_id"], ["label", "pos", "url"], room, rank="place").select(
            "job_id", "url", F.lit(hop).alias("hop"), rank.cast("bigint").alias("label"), rank.alias("rank"))
        if bounds["uncapped"]:
            wave = wave.unionByName(_labelled(fresh.where(F.col("max_urls") == 0), hop, behind))
        wave = wave.checkpoint()
        frontier = wave
        if state is not None and hop <= last_pending:
            frontier = wave.unionByName(pending.where(F.col("hop") == hop))
        if frontier.isEmpty() and hop >= last_pending:
            break
        visited = visited.unionByName(wave)
    return visited


def _labelled(fresh: DataFrame, hop: int, behind: int) -> DataFrame:
    """Visits of uncapped jobs: dealt by range, so that numbers ascend in (label, pos) without ranking a job."""
    order = ["job_id", "label", "pos", "url"]
    number = F.monotonically_increasing_id() + F.lit(behind)
    return fresh.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "job_id", "url", F.lit(hop).alias("hop"), number.alias("label"), F.lit(None).cast("int").alias("rank"))


def walk_state(visits: DataFrame, marks: DataFrame) -> DataFrame:
    """State of a walk, for ``crawl`` to go on from: visits with the state of marks(job_id, url, state), pending
    where there is none."""
    return visits.join(marks.select("job_id", "url", F.col("state").alias("_state")), ["job_id", "url"], "left").select(
        *visits.columns, F.coalesce("_state", F.lit("pending")).alias("state"))


def crawl_summary(state: DataFrame) -> DataFrame:
    """URLs processed / pending / failed per job."""
    counts = [F.count_if(F.col("state") == s).alias(s) for s in ("processed", "pending", "failed")]
    return state.groupBy("job_id").agg(*counts)

"""Job state as a keyed state machine over a stream of events.

Events are (job_id, url, event) with event queued, done or failed. A URL is pending from its first
queueing until its first outcome, then processed, failed or both, each once, as in ``mark_urls``: repeats change
nothing, an outcome of an unlisted URL adds it, and a URL with an outcome is not pending again, so the
result does not depend on the order of events. A job is cut into shards of URLs, so that a large job is no single key.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SHARDS = 64
CHANGES = ("job_id string, shard int, version bigint, url string, state string, "
           "pending bigint, processed bigint, failed bigint")
STATES = ("pending", "processed", "failed")
_OUTCOMES = {"done": 1, "failed": 2}


def use_keyed_state(spark: SparkSession) -> None:
    """Keep state in RocksDB, below the stream's checkpoint; Spark asks for it before a stateful stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class UrlShard(StatefulProcessor):
    """Marks of the URLs of one shard of a job, and how many URLs have each."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        marks = ", ".join(f"{s} boolean" for s in STATES)
        self.marks = handle.getMapState("marks", "url string", marks, self.ttl_ms)
        self.totals = handle.getValueState("totals", "version bigint, " + ", ".join(f"{s} bigint" for s in STATES))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        job_id, shard = key
        version, *totals = self.totals.get() if self.totals.exists() else (0, 0, 0, 0)
        changes = []
        for events in rows:
            events = events[["url", "event"]].drop_duplicates()
            for url, event in zip(events["url"], events["event"]):
                before = list(self.marks.getValue((url,))) if self.marks.containsKey((url,)) else [False] * 3
                after = list(before)
                if event in _OUTCOMES:
                    after[0], after[_OUTCOMES[event]] = False, True
                elif event == "queued" and not any(before):
                    after[0] = True
                if after != before:
                    self.marks.updateValue((url,), tuple(after))
                    totals = [n + new - old for n, new, old in zip(totals, after, before)]
                    changes += [(url, s) for s, new, old in zip(STATES, after, before) if new and not old]
        self.totals.update((version + 1, *totals))
        changes.append((None, None))  # the totals, also where nothing changed
        yield pd.DataFrame([(job_id, shard, version + 1, url, state, *totals) for url, state in changes],
                           columns=["job_id", "shard", "version", "url", "state", *STATES])

    def close(self) -> None:
        pass


def stream_job_changes(events: DataFrame, shards: int = SHARDS, ttl_ms: int | None = None) -> DataFrame:
    """Changes of state from a stream of events(job_id, url, event), for append mode.

    Each mark of a URL is one row, when it is first set; a row without url tells a shard's totals after a
    micro-batch. Rows without a job or url are left out. With ``ttl_ms`` the marks of a URL are forgotten that long
    (processing time) after the last of them changed, which bounds the state: a later outcome then counts as that of an
    unlisted URL and is told again. A URL forgotten while pending stays in the totals, so its job stays open.
    Time to live makes Spark run batches without data for ever: to ``drain`` such a stream, set
    spark.sql.streaming.noDataMicroBatches.enabled to false.
    """
    use_keyed_state(events.sparkSession)
    keyed = events.where(F.col("job_id").isNotNull() & F.col("url").isNotNull()).select(
        F.col("job_id").cast("string").alias("job_id"), "url", "event",
        F.pmod(F.xxhash64("url"), F.lit(shards)).cast("int").alias("shard"))
    return keyed.groupBy("job_id", "shard").transformWithStateInPandas(
        UrlShard(ttl_ms), CHANGES, "Append", "ProcessingTime" if ttl_ms else "None")


def url_states(changes: DataFrame) -> DataFrame:
    """state(job_id, url, state) as ``mark_urls`` gives it, from the changes told so far."""
    marks = changes.where(F.col("url").isNotNull()).groupBy("job_id", "url").agg(F.collect_set("state").alias("marks"))
    decided = F.array_remove("marks", "pending")
    return marks.select("job_id", "url", F.explode(
        F.when(F.size(decided) > 0, decided).otherwise(F.col("marks"))).alias("state"))


def job_states(changes: DataFrame) -> DataFrame:
    """Per job its URLs pending, processed and failed, and its status, from the newest totals of its shards.

    A job is closed (complete or partial) once nothing is pending in any shard; a URL queued later opens it again.
    """
    newest = changes.where(F.col("url").isNull()).groupBy("job_id", "shard").agg(
        F.max_by(F.struct(*STATES), "version").alias("t"))
    jobs = newest.groupBy("job_id").agg(*[F.sum(f"t.{s}").alias(s) for s in STATES])
    return jobs.withColumn("status", F.when(F.col("pending") > 0, "running").when(
        F.col("failed") > 0, "partial").otherwise("complete"))

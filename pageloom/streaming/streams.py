"""Incremental forms on Structured Streaming.

The stream's checkpoint takes the place of per-URL state files: an interrupted run continues with
the pages it has not seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pageloom.operators.html import parse_pages
from pageloom.operators.items import item_key
from pageloom.operators.links import extract_links
from pageloom.operators.select import element_records

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])


def stream_pages(spark: SparkSession, path: str, schema: T.StructType = PAGES,
                 files_per_batch: int = 1000, file_glob: str | None = None) -> DataFrame:
    """Page snapshots as a stream of Parquet files; ``file_glob`` is matched with names of files, not of folders."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    return reader.parquet(path)


def stream_table(spark: SparkSession, folder: str, name: str, schema: T.StructType = PAGES) -> DataFrame:
    """A table of a folder as a stream, be it one Parquet file or a folder of them.

    The braces make the path a pattern: a stream refuses the plain path of a single file.
    """
    return stream_pages(spark, f"{folder}/{{{name}.parquet}}", schema)


def stream_links(pages: DataFrame) -> DataFrame:
    """Links of newly arrived pages; stateless, one pass."""
    return extract_links(parse_pages(pages))


def stream_items(pages: DataFrame, selector: str) -> DataFrame:
    """Items of newly arrived pages under one selector; stateless."""
    return element_records(parse_pages(pages), selector)


def stream_dedup(items: DataFrame, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Drop items whose key the job has shown before.

    State is spread by (job, key), so a large job is not one task. With ``event_time`` keys are
    forgotten ``delay`` after they were last needed; without it state grows with distinct keys.
    """
    keyed = items.withColumn("_key", item_key(F.col("item")))
    if event_time:
        return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["job_id", "_key"]).drop("_key")
    return keyed.dropDuplicates(["job_id", "_key"]).drop("_key")


def stream_job_state(outcomes: DataFrame) -> DataFrame:
    """Latest state of every (job, URL) from outcomes(job_id, url, state, seq), in update mode."""
    return outcomes.groupBy("job_id", "url").agg(F.max_by("state", "seq").alias("state"))


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available now and stop; a later call continues after the checkpoint.

    In update mode each micro-batch is written with its batch id, and the newest one per key counts.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(path)
    else:
        def save(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        query = writer.foreachBatch(save).start()
    query.awaitTermination()

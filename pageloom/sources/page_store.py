"""Page snapshots kept in buckets, so that look-ups come to the HTML and not the HTML to them.

Selectors, fields and choices are small beside the pages, but outgrow a broadcast. Joined to pages in files, such a
table makes Spark shuffle all HTML; joined to pages in buckets by the same key, only the look-up moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_page_store(pages: DataFrame, table: str, key: str = "page_id", buckets: int | None = None,
                     mode: str = "errorifexists") -> None:
    """Store ``pages`` as a table in ``buckets`` by ``key``, sorted in each; null keys are kept in one of them.

    One shuffle of the HTML, once. ``buckets`` defaults to the session's shuffle partitions: with fewer, Spark takes the
    store for too coarse and shuffles both sides of a join. Choose it so that a bucket's HTML is some hundred megabytes.
    """
    spark = pages.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pages.repartition(buckets, key).write.mode(mode).format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def read_page_store(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)

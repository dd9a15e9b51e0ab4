"""Registry of runnable queries: name, Spark callable and, where one exists, the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.operators.html import parse_pages
from pageloom.sources.readers import read_pages, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
# Tables with long texts: work per row is large enough to be spread over all cores.
WIDE = ("pages", "documents")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; whole-number columns are widened to BIGINT so engines agree on types."""
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return widened(fn(spark, sf_dir))
        run.__doc__ = fn.__doc__
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def widened(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.col(f"`{name}`").cast("bigint").alias(name) if kind in ("int", "smallint", "tinyint") else F.col(f"`{name}`")
        for name, kind in df.dtypes])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_pages(spark, f"{sf_dir}/pages.parquet"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_pages(pages(spark, sf_dir))


def run_sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    """A derived input: SQL for both engines (array literals are spelled differently)."""
    text = text.replace("unnest(list_value(", "explode(array(")
    for name in tables:
        frame = table(spark, sf_dir, name)
        (spread(frame) if name in WIDE else frame).createOrReplaceTempView(name)
    return spark.sql(text)

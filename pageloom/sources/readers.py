"""Tables the operators start from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, types as T

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


INTENT = _struct(url=_S, intent_type=_S, content_target=_S, max_urls=_I, depth=_I,
                 output_format=_S, output_file=_S, paginate=_B, max_pages=_I)
RESULT = _struct(url=_S, links=T.ArrayType(_struct(text=_S, href=_S)), items=T.ArrayType(_S),
                 selector=_S, method=_S)
JOB = _struct(query=_S, intent=INTENT, job_id=_S, status=_S, urls_pending=T.ArrayType(_S),
              urls_processed=T.ArrayType(_S), urls_failed=T.ArrayType(_S),
              selector_cache=T.MapType(_S, _S), results=T.ArrayType(RESULT), output_format=_S,
              output_path=_S, created_at=_S, updated_at=_S)


def read_pages(spark: SparkSession, path: str,
               columns: Sequence[str] = ("page_id", "url", "html")) -> DataFrame:
    """Page snapshots from Parquet; only the listed columns are read."""
    return spark.read.parquet(path).select(*columns)


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    """Fetch attempts from Parquet."""
    return spark.read.parquet(path).select("url", "layer", "rnk", "status_code", "html", "error")


def read_jobs(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """S3: job documents, one JSON file each or (``one_per_file=False``) one per line; unreadable
    ones are skipped."""
    return (
        spark.read.schema(JOB).option("multiLine", one_per_file).option("mode", "DROPMALFORMED").json(path)
        .where("job_id is not null"))


def read_responses(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Stored model replies from Parquet, optionally of one kind."""
    replies = spark.read.parquet(path)
    return replies.where(replies["kind"] == kind) if kind else replies


def spread(df: DataFrame) -> DataFrame:
    """Repartition an input that has fewer splits than the cluster has cores (one small file).

    Large inputs already have more splits than cores and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows a compute function gets at once; bounds what a Python worker holds besides one Arrow batch.
SLICE = 256


def wide_rows(spark: SparkSession) -> None:
    """Small Arrow batches, since a row holds a whole text; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= 1024:
        spark.conf.set(key, "1024")


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null gives b''."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[bytes]], Sequence]], fields: str,
              keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns of ``keep``, and those of ``fields`` (DDL) that a function makes from whole texts.

    ``make`` runs once in each task and returns the function; that gets the UTF-8 of at most SLICE
    texts (null: empty) and returns one list or Arrow array for each field. Other columns are not
    read, so their names cannot clash; a kept column must not be called as a new field.
    """
    kept = df.select(*[F.col(f"`{c}`") for c in keep]).schema
    new = T.StructType.fromDDL(fields)
    kinds = [to_arrow_type(f.dataType) for f in new]
    names = [*keep, *new.names]

    def run(batches):
        compute = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = compute(text_bytes(part.column(len(keep))))
                made = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], *made], names=names)

    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    return source.mapInArrow(run, T.StructType([*kept.fields, *new.fields]))


def text_key(text: str | Column = "text") -> Column:
    """16 bytes that stand for a whole text (null as empty): tells rows with the same id apart."""
    return F.unhex(F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))))

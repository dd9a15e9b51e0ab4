"""Places of rows in a total order, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageloom.session import scratch_path

#: monotonically_increasing_id keeps the task above this bit and the row's place in it below.
PART_BITS = 33


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def in_order(df: DataFrame, order: Sequence[Column], name: str, at: str = "at") -> DataFrame:
    """The rows of ``df`` with a number ``at`` that ascends in ``order``, stored once.

    Rows are dealt by range of the whole order, so no group has to fit in a task. Dealing reads ``df``
    twice (it samples first): give it narrow, stored rows. Numbers have gaps where a part begins.
    """
    return stored(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), name)


def part_of(at: str = "at") -> Column:
    return F.shiftright(at, PART_BITS)


def group_runs(rows: DataFrame, group: str) -> DataFrame:
    """part, ``group``, first, size, before, n, group_no for each stretch of a group in a part of in_order's rows.

    ``first`` is the stretch's least number, ``before`` the group's rows in earlier parts, ``n`` all its rows,
    ``group_no`` the place of the group among all groups, from 0. Windows see a row for each part and group.
    """
    runs = rows.groupBy(part_of().alias("part"), group).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    parts = Window.partitionBy(group).orderBy("part")
    runs = stored(
        runs.withColumn("before", F.sum("size").over(parts) - F.col("size"))
        .withColumn("n", F.sum("size").over(Window.partitionBy(group)))
        .withColumn("begins", F.row_number().over(parts) == 1), "runs")
    # one row for each part that groups begin in, so as many as the tasks that dealt
    begun = runs.where("begins").groupBy("part").agg(F.count(F.lit(1)).alias("begun"))
    begun = begun.select("part", (F.sum("begun").over(Window.orderBy("part")) - F.col("begun")).alias("earlier"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("first"))
    numbers = (
        runs.where("begins").join(begun, "part")
        .select(F.col(group).alias("of"), (F.col("earlier") + place - 1).cast("long").alias("group_no")))
    return runs.join(numbers, F.col(group).eqNullSafe(F.col("of"))).drop("of", "begins")

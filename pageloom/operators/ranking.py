"""Ranks inside groups of any size: no window ever sees a whole hot group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageloom.session import scratch_path, use_checkpoint_dir


def first_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: Column,
                    salts: int = 64, rank: str = "rank") -> DataFrame:
    """Exact first ``k`` rows of every key in ``order`` (unique per key), with their rank from 1.

    Each key is ranked in ``salts`` independent parts first; only the first ``k`` of each part can be
    among the first ``k`` overall, so the final window holds at most ``salts * k`` rows per key.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(salts))
    local = Window.partitionBy(*keys, "_part").orderBy(*order)
    overall = Window.partitionBy(*keys).orderBy(*order)
    limited = (
        df.withColumn("_k", k).withColumn("_part", part)
        .withColumn("_place", F.row_number().over(local)).where(F.col("_place") <= F.col("_k")))
    return (
        limited.withColumn(rank, F.row_number().over(overall)).where(F.col(rank) <= F.col("_k"))
        .drop("_k", "_part", "_place"))


def number_rows(df: DataFrame, keys: Sequence[str], seq: str, ties: Sequence[str] = (),
                name: str = "row_no") -> DataFrame:
    """Number the rows of every key from 1 by (seq, ties), also for keys holding billions of rows.

    Rows are dealt by range of (keys, seq, ties), so a hot key is spread over tasks whatever its
    values are. A row's number is its place among the key's rows of its part plus the key's rows in
    earlier parts; the window is over one row per key and part. Places depend on how rows were dealt,
    so they are stored once (checkpoint) before anything is counted. Null keys and a null ``seq``
    are numbered like other values, nulls first.
    """
    use_checkpoint_dir(df.sparkSession)
    order = [*keys, seq, *ties]
    placed = (
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id()).checkpoint())
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_part").alias("_of_part"),
                (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")))
    # a row for each key and part, stored: the planner sees its size and joins a small one without moving the rows again
    path = scratch_path(df.sparkSession, "shifts")
    shifts.write.parquet(path)
    shifts = df.sparkSession.read.parquet(path)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys],
                  F.col("_part") == F.col("_of_part"))
    return (
        placed.join(shifts, same).withColumn(name, F.col("_at") + F.col("_shift") + 1)
        .drop("_part", "_at", "_of_part", "_shift", *[f"_of_{k}" for k in keys]))

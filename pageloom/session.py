"""Session settings the operators rely on, and the checkpoint location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Pages are wide rows: keep the Arrow batches handed to the parse stage small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}


def local_session(cores: str = "*", name: str = "pageloom", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster pass SETTINGS to spark-submit."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    defaults = {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
                "spark.driver.memory": "8g", "spark.driver.host": "127.0.0.1"}
    for key, value in {**defaults, **SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable: the session's shared folder wins, a temporary one only
    in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pageloom-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder, which every executor can reach."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"

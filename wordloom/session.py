"""Session helpers: where checkpoints live, and how to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting one only when none is configured.

    A cluster names a shared folder in ``spark.checkpoint.dir``.  Only a local
    master may fall back to a temporary folder: on a cluster that would put
    checkpoints on a disk which other executors cannot read.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="wordloom-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the checkpoint folder and read it back.

    Used where a value must stay the same between two passes (a sampled range
    layout, a fitted model's output) or where a loop would grow its lineage.
    The files survive lost executors.  A table also carries its true size,
    whereas the estimates of a checkpointed plan multiply from join to join
    until planning itself becomes the slow part of a loop.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

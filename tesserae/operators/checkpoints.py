"""Cutting lineage by checkpoints in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, from spark.checkpoint.dir. Where that is unset, a local session gets a temporary one; a cluster, whose
    executors couldn't share it, is refused."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tesserae-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it from there: a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """As cut(), as a Parquet table in the shared folder: for many rounds of joins, since a checkpoint carries on the estimated sizes
    of its plan, which multiply with each join, and a table has its own."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Shuffle files of what was written and isn't referred to any more are deleted once the JVM has collected its garbage: here, not some
    time. Twice, since the JVM learns a moment later what Python has dropped."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)

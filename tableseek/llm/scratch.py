"""Results that a job needs twice, kept in the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
    return folder.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once, read back: later stages do not repeat the work, and a lost executor costs nothing."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Intermediate tables that several later steps read."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used in local mode only, where driver and executors are one machine.
LOCAL = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; in local mode without it one of our own."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{LOCAL}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: it is made once and outlives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/cauceda/cut-{uuid.uuid4().hex}"
    if path.startswith(f"file://{LOCAL}/"):
        atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

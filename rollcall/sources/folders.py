"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where that is unset, a local session gets a temporary one."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not at:
        at = tempfile.mkdtemp(prefix="checkpoints")
        sc.setCheckpointDir(at)
    return at


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that isn't used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

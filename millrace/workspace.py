"""Folders for written intermediate tables and stream checkpoints."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """Return the folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; a cluster session
    is refused, because executors do not share a machine-local folder.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def run_folder(spark: SparkSession, label: str) -> str:
    """Return a new path below the shared folder; nothing is created yet."""
    return f"{shared_root(spark)}/{label}-{uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of that copy.

    Cuts the lineage, and fixes values that a recomputation could change, such as
    partition numbers. The copy outlives the session; whoever owns the shared
    folder expires it. It is compressed with zstd, as it is read only a few times.
    """
    path = run_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""The event table as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import to_instant
from ..sources import SCHEMAS


FILES_PER_BATCH = 100
ALL_FILES = 2**31 - 1


def event_stream(spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Stream the parquet file or folder at ``path``; ``files_per_batch`` files at a time.

    ``ts`` becomes a ``timestamp``, the only type that a watermark can be set on.
    """
    reader = spark.readStream.schema(SCHEMAS["events"])
    reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # A plain path has to be a folder; a pattern, here one that only this name matches,
    # may also name a file.
    folder, name = path.rstrip("/").rsplit("/", 1)
    return reader.parquet(f"{folder}/{{{name}}}").withColumn("ts", to_instant("ts"))

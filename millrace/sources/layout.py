"""Tables kept bucketed by their join key, so that joining and summing by it needs no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SkewedKey(ValueError):
    """One key holds too many rows for the table to be bucketed by it."""


def save_bucketed(
    df: DataFrame, table: str, key: str, buckets: int, path: str, max_fill: float = 2.0
) -> None:
    """Save ``df`` as catalog table ``table`` at ``path``, in one file per bucket of ``key``.

    Tables joined on the key want the same number of buckets: bytes of the largest / 1 GB
    or less. A bucket is read by one task and can't be split. So :class:`SkewedKey` is
    raised where one key alone would exceed ``max_fill`` times the average bucket; leave
    such a table in plain files, where jobs sum a hot key before they shuffle it.
    """
    rows, largest = df.groupBy(key).count().agg(F.sum("count"), F.max("count")).first()
    if rows and largest > max_fill * rows / buckets:
        raise SkewedKey(f"one {key} has {largest} of {rows} rows: too many for {buckets} buckets")
    (
        df.repartition(buckets, key)
        .write.format("parquet")
        .bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .saveAsTable(table)
    )

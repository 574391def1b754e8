"""Spark session with the settings the jobs in this package are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Set only where neither the cluster's own defaults nor the caller has a value.
DEFAULTS = {
    # Event times are wall-clock values without a zone; UTC keeps casts from moving them.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # Splits a shuffle partition that one hot join key has blown up.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def session(
    name: str = "millrace",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    settings: dict[str, str] | None = None,
) -> SparkSession:
    """Return the active session as it is, or a new one; pass ``master`` only for local runs.

    ``shuffle_partitions`` is the upper bound that adaptive execution coalesces
    from, so size it for the largest shuffle: bytes shuffled / 128 MB.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(name)
    if master is not None:
        builder = builder.master(master)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (settings or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    given = spark.sparkContext.getConf()
    for key, value in DEFAULTS.items():
        if not given.contains(key):
            spark.conf.set(key, value)
    return spark

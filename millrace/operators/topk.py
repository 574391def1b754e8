"""The first k rows of every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(
    df: DataFrame, k: int, keys: list[str], order: list[Column], rank: str = "rank", salts: int = 32
) -> DataFrame:
    """Keep the first ``k`` rows of each group and number them in column ``rank``.

    ``order`` has to be total within a group for a repeatable result. Spark turns
    this window and filter into a group limit that also runs before the shuffle, so
    each map task sends at most ``k`` rows of a group, however hot the group is. Spark does
    so up to a threshold of ``k`` only; beyond it a first step finds the first k rows of
    each of ``salts`` parts of a group, so one task gets at most k * salts rows in the second.
    """
    threshold = df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")
    if k > int(threshold):
        part = F.pmod(F.xxhash64(*df.columns), F.lit(salts)).alias("_part")
        within = Window.partitionBy(*keys, "_part").orderBy(*order)
        parts = df.select("*", part).withColumn("_nth", F.row_number().over(within))
        df = parts.filter(F.col("_nth") <= k).drop("_part", "_nth")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)

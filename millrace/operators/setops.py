"""Set and multiset operations on rows with the same columns.

Apart from the union, each is one aggregation of both sides together: a value's copies
are counted in the map tasks, so only one row per value, side and task is shuffled, and
no join can meet a value with very many copies. Nulls count as equal, as in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side, without copies."""
    return left.unionByName(right).distinct()


def intersect_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in both, without copies."""
    return _counted(left, right).filter("_left > 0 and _right > 0").select(*left.columns)


def except_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` that are not in ``right``, without copies."""
    return _counted(left, right).filter("_left > 0 and _right = 0").select(*left.columns)


def intersect_all(left: DataFrame, right: DataFrame, block: int = 100_000) -> DataFrame:
    """Rows in both, each as often as in the side that has fewer of it."""
    return _copies(left, right, F.least("_left", "_right"), block)


def except_all(left: DataFrame, right: DataFrame, block: int = 100_000) -> DataFrame:
    """Rows of ``left``, each less often by its count in ``right``."""
    return _copies(left, right, F.col("_left") - F.col("_right"), block)


def _counted(left: DataFrame, right: DataFrame) -> DataFrame:
    columns = left.columns
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return (
        left.select(*columns, one.alias("_left"), none.alias("_right"))
        .unionAll(right.select(*columns, none.alias("_left"), one.alias("_right")))
        .groupBy(*columns)
        .agg(F.sum("_left").alias("_left"), F.sum("_right").alias("_right"))
    )


def _copies(left: DataFrame, right: DataFrame, copies: Column, block: int) -> DataFrame:
    columns = left.columns
    counted = (
        _counted(left, right).select(*columns, copies.alias("_copies")).filter("_copies > 0")
    )
    # The copies of one value are written out in blocks that are spread over tasks; a
    # fixed partition number keeps adaptive execution from putting the (still tiny)
    # blocks together again.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.sequence(F.lit(0), F.expr(f"(_copies - 1) div {block}"))
    rest = F.least(F.lit(block), F.col("_copies") - F.col("_block") * block)
    return (
        counted.withColumn("_block", F.explode(blocks))
        .repartition(tasks, *columns, "_block")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), rest)))
        .select(*columns)
    )

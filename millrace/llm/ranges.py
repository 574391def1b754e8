"""Running totals over one global order, without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import written


def running_total(
    df: DataFrame, order: list[str], value: str, name: str, pieces: int | None = None
) -> DataFrame:
    """Add the sum of ``value`` over this row and all before it in ascending ``order``.

    Rows are cut by range into ``pieces`` (the session's shuffle partitions, unless given)
    and written once, because both the sums per piece and the rows have to see the same
    cuts, also when an executor is lost. Rows that are equal in all of ``order`` stay in
    one piece, so ``order`` should be total or nearly so. Null values count as 0 and an
    empty table gives an empty result. Needs folder ``spark.checkpoint.dir``; runs jobs.
    """
    pieces = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    amount = F.coalesce(F.col(value), F.lit(0))
    cut = written(
        df.repartitionByRange(pieces, *order).withColumn("_piece", F.spark_partition_id()),
        "ranges",
    )
    # One row per piece; the window below and the broadcast are bounded by their number.
    sums = cut.groupBy("_piece").agg(F.sum(amount).alias("_sum"))
    earlier = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        "_piece", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")
    )
    to_here = (
        Window.partitionBy("_piece")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inside = cut.withColumn("_inside", F.sum(amount).over(to_here))
    return (
        inside.join(F.broadcast(before), "_piece")
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .select(*df.columns, name)
    )

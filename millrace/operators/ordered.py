"""Running totals and previous-row values in the time order of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import shared_root, written


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    totals: dict[str, Column] | None = None,
    previous: dict[str, str] | None = None,
    max_group_rows: int = 10_000_000,
    piece_rows: int = 10_000_000,
) -> DataFrame:
    """Add running totals, and values of the row before, per group.

    ``totals`` maps a new column to the expression that it sums from the first row of
    the group to the current one; ``previous`` maps a new column to the column that it
    reads from the row before. ``order`` (ascending) has to be total within a group.

    A window puts a whole group into one task. That is used while no group has more
    than ``max_group_rows`` rows, which one counting pass finds out. Beyond that, the
    rows are cut by range into pieces of about ``piece_rows``, so that a group may span
    many of them, and what precedes a piece is carried into it. Both give equal rows.
    """
    shared_root(df.sparkSession)  # asked for at every size, so that growth can't break a job
    totals, previous = totals or {}, previous or {}
    largest, rows = (
        df.groupBy(*keys).count().agg(F.max("count"), F.coalesce(F.sum("count"), F.lit(0))).first()
    )
    window = Window.partitionBy(*keys).orderBy(*order)
    plain = df.select("*", *_over(window, totals, previous))
    if (largest or 0) <= max_group_rows:
        return plain
    pieces = -(-rows // piece_rows)
    result = _in_pieces(df, keys, order, totals, previous, pieces)
    return result.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in plain.schema))


def _over(window, totals: dict[str, Column], previous: dict[str, str]) -> list[Column]:
    to_here = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return [F.sum(value).over(to_here).alias(name) for name, value in totals.items()] + [
        F.lag(source).over(window).alias(name) for name, source in previous.items()
    ]


def _in_pieces(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    totals: dict[str, Column],
    previous: dict[str, str],
    pieces: int,
) -> DataFrame:
    # Written once, because both branches below have to see the same cuts, and a second
    # sampling of the ranges, or a recomputed task, could move them.
    cut = written(
        df.repartitionByRange(pieces, *keys, *order).withColumn("_piece", F.spark_partition_id()),
        "pieces",
    )

    inside = Window.partitionBy("_piece", *keys).orderBy(*order)
    rows = cut.select(
        "*", F.row_number().over(inside).alias("_nth"), *_over(inside, totals, previous)
    )

    last_row = F.struct(*(F.col(source).alias(name) for name, source in previous.items()))
    sums = cut.groupBy("_piece", *keys).agg(
        *(F.sum(value).alias(name) for name, value in totals.items()),
        *([F.max_by(last_row, F.struct(*order)).alias("_last")] if previous else []),
        F.count(F.lit(1)).alias("_rows"),
    )
    by_piece = Window.partitionBy(*keys).orderBy("_piece")
    before = by_piece.rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        F.col("_piece").alias("_into"),
        *(F.col(key).alias(f"_key_{key}") for key in keys),
        *(F.sum(name).over(before).alias(f"_sum_{name}") for name in totals),
        *([F.lag("_last").over(by_piece).alias("_before")] if previous else []),
        F.row_number().over(by_piece).alias("_nth_piece"),
    ).filter("_nth_piece > 1")

    # Ranges are contiguous, so at most one group continues into a piece from the one
    # before: this side has fewer rows than there are pieces. Spark chooses how to join it.
    same = [F.col("_piece") == F.col("_into")] + [
        F.col(key).eqNullSafe(F.col(f"_key_{key}")) for key in keys
    ]
    joined = rows.join(carried, same, "left")
    return joined.select(
        *df.columns,
        *(
            F.coalesce(F.col(f"_sum_{name}") + F.col(name), name, f"_sum_{name}").alias(name)
            for name in totals
        ),
        *(
            F.when(F.col("_nth") == 1, F.col(f"_before.{name}")).otherwise(F.col(name)).alias(name)
            for name in previous
        ),
    )

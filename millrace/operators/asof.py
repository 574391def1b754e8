"""Each row joined with the latest earlier, or the earliest later, row of another table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import written
from .intervals import ticks


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: dict[str, str],
    at: dict[str, str],
    ties: list[str],
    forward: bool = False,
    tolerance: int | None = None,
    exact: bool = True,
    pieces: int | None = None,
) -> DataFrame:
    """Every row of ``left`` once, with the columns of its match in ``right``, null where there is none.

    The match has equal keys (``on`` maps left to right columns) and the latest time that is not
    after the row's own, or with ``forward`` the earliest not before it; ``at`` maps the one time
    column to the other, both timestamps or whole numbers. Equal times match unless ``exact`` is
    off. Of right rows with equal keys and time the one with the greatest ``ties`` is taken, nulls
    least; rows equal in all of these count as one. A match further off than ``tolerance``
    (microseconds for timestamps) is none. Column names of both tables have to differ.
    Rows of ``left`` with a null key or time are kept without a match; such rows of ``right`` match nothing.
    Repeated left rows are all kept, and an empty table on either side is allowed.

    Both tables are sorted together by key and time into ``pieces`` ranges (the shuffle partitions,
    unless given), so a hot key spans many tasks; the last match of every key is carried from
    range to range, one row per range at most. The ranges are written to the shared folder once,
    as both branches have to see the same cuts. Runs jobs.
    """
    ((left_at, right_at),) = at.items()
    if both := set(left.columns) & set(right.columns):
        raise ValueError(f"both tables have {', '.join(sorted(both))}")
    spark = left.sparkSession
    pieces = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_key_{n}" for n in range(max(1, len(on)))]

    def prepared(df: DataFrame, own: list[str], time: str, side: int, values: list[Column]) -> DataFrame:
        named = [F.col(c).alias(k) for c, k in zip(own, keys)] or [F.lit(0).alias(keys[0])]
        return df.select(*named, ticks(df, time).alias("_at"), F.lit(side).alias("_side"), *values)

    def whole(df: DataFrame) -> Column:
        return F.struct(*(F.col(c) for c in df.columns))

    def nothing(df: DataFrame) -> Column:
        return F.lit(None).cast(df.select(whole(df).alias("x")).schema["x"].dataType)

    def known(df: DataFrame, own: list[str], time: str) -> Column:
        found = F.col(time).isNotNull()
        for c in own:
            found = found & F.col(c).isNotNull()
        return found

    complete = known(left, [*on], left_at)
    tie = F.struct(*(F.col(c) for c in ties)) if ties else F.lit(0)
    no_tie = F.lit(None).cast(right.select(tie.alias("x")).schema["x"].dataType)
    asked = prepared(
        left.filter(complete), [*on], left_at, 1 if exact else 0,
        [whole(left).alias("_left"), nothing(right).alias("_right"), no_tie.alias("_tie")],
    )
    given = prepared(
        right.filter(known(right, [*on.values()], right_at)), [*on.values()], right_at, 0 if exact else 1,
        [nothing(left).alias("_left"), whole(right).alias("_right"), tie.alias("_tie")],
    )
    rows = asked.unionByName(given)
    # One ascending order serves both directions.
    rows = rows.withColumn("_at", -F.col("_at") if forward else F.col("_at"))
    order = ["_at", "_side", "_tie"]
    cut = written(
        rows.repartitionByRange(pieces, *keys, *order).withColumn("_piece", F.spark_partition_id()),
        "ranges",
    )

    here = F.struct(F.col("_at").alias("at"), F.col("_right").alias("row"))
    here = F.when(F.col("_right").isNotNull(), here)
    window = Window.partitionBy("_piece", *keys).orderBy(*order)
    to_here = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = cut.select("*", F.last(here, ignorenulls=True).over(to_here).alias("_match"))
    found = found.filter("_left is not null")

    # Only a range's last key goes on into the next one, and only into its first key: two rows per
    # range meet by key, and the carried ones are at most one per range.
    key = F.struct(*keys)
    ends = cut.groupBy("_piece").agg(
        F.min(key).alias("_first"),
        F.max(key).alias("_key"),
        F.max_by(
            F.struct(key.alias("key"), here.alias("match")),
            F.when(F.col("_right").isNotNull(), F.struct(*keys, *order)),
        ).alias("_last"),
    )
    own = F.when(F.col("_last.key") == F.col("_key"), F.col("_last.match"))
    nothing_yet = F.when(F.lit(False), own)
    both_ends = F.array(
        F.struct(F.col("_first").alias("key"), F.lit(0).alias("end"), nothing_yet.alias("match")),
        F.struct(F.col("_key").alias("key"), F.lit(1).alias("end"), own.alias("match")),
    )
    ends = ends.select("_piece", F.explode(both_ends).alias("x")).select("_piece", "x.*")
    earlier = Window.partitionBy("key").orderBy("_piece", "end")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        F.col("_piece").alias("_into"),
        F.col("key").alias("_key"),
        "end",
        F.last("match", ignorenulls=True).over(earlier).alias("_before"),
    ).filter("end = 0 and _before is not null")
    same = (F.col("_piece") == F.col("_into")) & (key == F.col("_key"))
    found = found.join(carried, same, "left").select("_left", "_at", "_match", "_before")
    match = F.coalesce("_match", "_before")
    found = found.select("_left", "_at", match.alias("_match"))
    if tolerance is not None:
        near = F.col("_at") - F.col("_match.at") <= tolerance
        found = found.withColumn("_match", F.when(near, F.col("_match")))
    matched = found.select(
        *(F.col("_left")[c].alias(c) for c in left.columns),
        *(F.col("_match.row")[c].alias(c) for c in right.columns),
    )
    alone = left.filter(~complete).select(
        "*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema)
    )
    return matched.unionByName(alone)

"""Points joined with the spans that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from ..functions import micros

_STEP = 3


def ticks(df: DataFrame, column: str) -> Column:
    """A point in time as microseconds, or a whole number as it is."""
    kind = df.schema[column].dataType
    if isinstance(kind, TimestampNTZType):
        return micros(column)
    if isinstance(kind, TimestampType):
        return F.unix_micros(column)
    return F.col(column).cast("bigint")


def interval_join(
    points: DataFrame,
    spans: DataFrame,
    at: str,
    start: str,
    end: str,
    on: dict[str, str] | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """Every pair of a row of ``points`` and one of ``spans`` with start <= at < end and equal keys.

    ``on`` maps key columns of ``points`` to those of ``spans``; without any, all spans count. Times
    are timestamps or whole numbers. Column names of both tables have to differ. Rows with a null time or
    key are in no pair, nor are spans that end where they start or before. Repeated rows are
    paired each for itself.

    Time is cut into bins of several widths, each eight times the one below. A span goes
    to the bins it touches of the least width above its own length, two at most; a point goes to one
    bin of every width that some span has. So the pairs compared are few times the pairs there
    are, for short spans and long ones, and a hot key falls apart in time. Spans longer than the
    span of all points / ``pieces`` (4 times the shuffle partitions, unless given) are cut into that many
    bins at most, so that even one that holds all points is worked on by many tasks. A crowded bin
    is split by adaptive execution, as both sides are plain shuffles. Two small jobs run: the
    times of the points and the widths of the spans.
    """
    on = on or {}
    if both := set(points.columns) & set(spans.columns):
        raise ValueError(f"both tables have {', '.join(sorted(both))}")
    left, right = in_bins(points, spans, at, start, end, on, pieces)
    same = (F.col("_width") == F.col("_level")) & (F.col("_place") == F.col("_bin"))
    for a, b in on.items():
        same = same & (left[a] == right[b])
    inside = (F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_end"))
    return left.join(right, same & inside).select(*points.columns, *spans.columns)


def in_bins(
    points: DataFrame,
    spans: DataFrame,
    at: str,
    start: str,
    end: str,
    on: dict[str, str],
    pieces: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Points with _at, _width and _place, spans with _start, _end, _level and _bin, copied to bins."""
    pieces = pieces or 4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = points.withColumn("_at", ticks(points, at)).filter("_at is not null")
    spans = spans.withColumns({"_start": ticks(spans, start), "_end": ticks(spans, end)})
    spans = spans.filter("_start < _end")
    for left, right in on.items():
        points, spans = points.filter(F.col(left).isNotNull()), spans.filter(F.col(right).isNotNull())

    first, last = points.agg(F.min("_at"), F.max("_at")).first()
    if first is None:
        first = last = 0
    # What lies outside of all points holds none.
    spans = spans.filter((F.col("_end") > first) & (F.col("_start") <= last))
    low, high = F.greatest("_start", F.lit(first)), F.least(F.col("_end") - 1, F.lit(last))
    widest = _level(max(1, (last - first) // pieces))
    steps = F.ceil(F.length(F.bin(high - low)) / _STEP)
    spans = spans.withColumn("_level", F.least(F.lit(widest), steps * _STEP).cast("int"))
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect())

    def bin_of(value: Column, level: str) -> Column:
        return F.call_function("shiftright", value, F.col(level))

    bins = F.sequence(bin_of(low, "_level"), bin_of(high, "_level"))
    widths = F.array(*(F.lit(x).cast("int") for x in levels)).cast("array<int>")
    points = points.withColumn("_width", F.explode(widths))
    points = points.withColumn("_place", bin_of(F.col("_at"), "_width"))
    return points, spans.withColumn("_bin", F.explode(bins))


def _level(width: int) -> int:
    """The least multiple of the step for which a bin is at least ``width`` wide."""
    return -(-(width - 1).bit_length() // _STEP) * _STEP

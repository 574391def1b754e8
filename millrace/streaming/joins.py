"""Pairs of rows of two streams that are near in time."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import interval


@dataclass(frozen=True)
class Side:
    """One side: its stream, its event time, how late it may be, and which of its rows take part.

    ``columns`` maps new names to columns; the event time is named ``at``.
    """

    stream: DataFrame
    ts: str
    delay: timedelta
    columns: dict[str, Column]
    at: str
    where: Column | None = None

    def rows(self) -> DataFrame:
        rows = self.stream.withWatermark(self.ts, interval(self.delay))
        rows = rows if self.where is None else rows.filter(above_watermark(self.ts, self.where))
        columns = {name: above_watermark(self.ts, value) for name, value in self.columns.items()}
        columns[self.at] = F.col(self.ts)
        return rows.select(*(value.alias(name) for name, value in columns.items()))


def above_watermark(ts: str, value: Column) -> Column:
    """``value`` of rows with an event time, in a form that Spark leaves above the watermark.

    Filters, also those that a join's keys imply, else move below it, and rows that take no
    part would not move the watermark: a rare kind of event would hold back all state.
    """
    return F.when(F.col(ts).isNotNull(), value)


def pairs_within(
    left: Side, right: Side, on: dict[str, str], within: timedelta, outer: bool = False
) -> DataFrame:
    """Every pair with equal keys and left time <= right time < left time + ``within``.

    ``on`` maps left to right columns. With ``outer`` a left row without a pair comes once, with nulls,
    after the watermark has ruled pairs out; rows with a null key or time have none. Repeated rows
    are paired each for itself. Rows later than their side's delay are dropped.

    State is bounded on both sides: a left row is kept until the watermark is ``within`` past it,
    a right row until the watermark is past it. The watermark is the lower one of both sides. All
    rows of a key of the last ``within`` plus delays meet in one task.
    """
    a, b = left.rows(), right.rows()
    same = [a[x] == b[y] for x, y in on.items()]
    near = [b[right.at] >= a[left.at], b[right.at] < a[left.at] + F.lit(within)]
    condition = near[0] & near[1]
    for one in same:
        condition = one & condition
    return a.join(b, condition, "left_outer" if outer else "inner")

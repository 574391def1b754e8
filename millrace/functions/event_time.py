"""Event times that carry no time zone.

The event tables hold ``timestamp_ntz``. Watermarks accept only ``timestamp``, and
a plain cast between the two goes through the session time zone, which skips or
repeats an hour where daylight saving changes. These helpers read the wall clock
as UTC whatever the session zone is.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _column(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def span_micros(span: Column) -> Column:
    """Microseconds in a day-time interval, as bigint."""

    def part(unit: str) -> Column:
        return F.extract(F.lit(unit), span).cast("bigint")

    minutes = (part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")
    seconds = F.extract(F.lit("SECOND"), span)  # decimal(8,6), with the fraction
    return minutes * 60_000_000 + (seconds * 1_000_000).cast("bigint")


def micros(column: str | Column) -> Column:
    """Microseconds since 1970 of a ``timestamp_ntz``, as bigint."""
    return span_micros(_column(column) - F.expr(_EPOCH))


def to_instant(column: str | Column) -> Column:
    """``timestamp_ntz`` to ``timestamp``, reading the wall clock as UTC."""
    return F.timestamp_micros(micros(column))


def from_instant(column: str | Column) -> Column:
    """``timestamp`` to ``timestamp_ntz``: the UTC wall clock of that instant."""
    return F.expr(_EPOCH) + F.unix_micros(_column(column)) * F.lit(timedelta(microseconds=1))


def interval(span: timedelta) -> str:
    """The span as the interval text that ``window`` and ``withWatermark`` take."""
    return f"{span // timedelta(microseconds=1)} microseconds"

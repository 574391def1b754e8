"""Measures that can be aggregated in two steps without changing the result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# name -> (how it combines, what is measured per row)
Measures = dict[str, tuple[str, Column]]

_COMBINE = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.sum}


def count_rows() -> tuple[str, Column]:
    """A row count, which combines as a sum and is 0, not null, over no rows."""
    return "count", F.lit(1).cast("bigint")


def from_rows(measures: Measures) -> list[Column]:
    """Aggregates over input rows."""
    return [_combined(how, value).alias(name) for name, (how, value) in measures.items()]


def from_parts(measures: Measures) -> list[Column]:
    """Aggregates over the results of :func:`from_rows`."""
    return [_combined(how, F.col(name)).alias(name) for name, (how, _) in measures.items()]


def _combined(how: str, value: Column) -> Column:
    combined = _COMBINE[how](value)
    return F.coalesce(combined, F.lit(0).cast("bigint")) if how == "count" else combined

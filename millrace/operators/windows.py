"""Event-time windows over whole tables. The streaming forms are in ``streaming``.

Rows without an event time belong to no window.
"""

from __future__ import annotations

from datetime import timedelta
from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import interval
from .measures import Measures, from_parts, from_rows

_MICRO = timedelta(microseconds=1)


def tumbling(
    df: DataFrame, ts: str, size: timedelta, keys: list[str], measures: Measures
) -> DataFrame:
    """Aggregate per window of ``size`` and ``keys``; windows start at the epoch."""
    return (
        df.groupBy(F.window(ts, interval(size)).alias("_window"), *keys)
        .agg(*from_rows(measures))
        .select(*_bounds("_window"), *keys, *measures)
    )


def sliding(
    df: DataFrame,
    ts: str,
    size: timedelta,
    slide: timedelta,
    keys: list[str],
    measures: Measures,
) -> DataFrame:
    """Aggregate per window of ``size`` that starts every ``slide``.

    Spark copies a row into each window that covers it. Here rows are first summed
    into panes that lie wholly inside or outside any window, and only those are copied.
    """
    pane = gcd(size // _MICRO, slide // _MICRO) * _MICRO
    panes = df.groupBy(F.window(ts, interval(pane)).start.alias("_pane"), *keys).agg(
        *from_rows(measures)
    )
    return (
        panes.groupBy(F.window("_pane", interval(size), interval(slide)).alias("_window"), *keys)
        .agg(*from_parts(measures))
        .select(*_bounds("_window"), *keys, *measures)
    )


def sessions(
    df: DataFrame, ts: str, gap: timedelta, keys: list[str], measures: Measures
) -> DataFrame:
    """Aggregate per session: a run of events of one key that are at most ``gap`` apart.

    As with Spark's ``session_window``, a session ends ``gap`` after its last event.

    Events of one key that fall into the same ``gap``-wide slot always share a session.
    They are summed before the shuffle, so a key brings at most one row per slot and
    map task to it, however many events it has.
    """
    slots = df.groupBy(*keys, F.window(ts, interval(gap)).start.alias("_slot")).agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), *from_rows(measures)
    )
    by_key = Window.partitionBy(*keys).orderBy("_slot")
    apart = F.col("_first") - F.lag("_last").over(by_key) > F.lit(gap)
    numbered = slots.withColumn("_apart", F.coalesce(apart.cast("int"), F.lit(0))).withColumn(
        "_session", F.sum("_apart").over(by_key.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        numbered.groupBy(*keys, "_session")
        .agg(
            F.min("_first").alias("session_start"),
            (F.max("_last") + F.lit(gap)).alias("session_end"),
            *from_parts(measures),
        )
        .drop("_session")
    )


def _bounds(window: str) -> list:
    return [
        F.col(f"{window}.start").alias("window_start"),
        F.col(f"{window}.end").alias("window_end"),
    ]

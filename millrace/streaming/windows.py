"""Stateful stream operators with bounded state.

All take a stream whose ``ts`` column is a ``timestamp`` and the delay after which
an event is too late. In append mode a window is emitted once the watermark has
passed its end, and its state is dropped. A watermark starts at 1970, so earlier events
are late from the first batch on. Results carry ``timestamp_ntz`` bounds, like
the batch forms in ``operators.windows``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import from_instant, interval
from ..operators.measures import Measures, from_rows


def tumbling_windows(
    stream: DataFrame,
    ts: str,
    size: timedelta,
    keys: list[str],
    measures: Measures,
    delay: timedelta,
) -> DataFrame:
    """Aggregate per window of ``size`` and ``keys``."""
    return _windowed(stream, ts, F.window(ts, interval(size)), keys, measures, delay).select(
        *_bounds("window"), *keys, *measures
    )


def sliding_windows(
    stream: DataFrame,
    ts: str,
    size: timedelta,
    slide: timedelta,
    keys: list[str],
    measures: Measures,
    delay: timedelta,
) -> DataFrame:
    """Aggregate per window of ``size`` that starts every ``slide``."""
    window = F.window(ts, interval(size), interval(slide))
    return _windowed(stream, ts, window, keys, measures, delay).select(
        *_bounds("window"), *keys, *measures
    )


def session_windows(
    stream: DataFrame,
    ts: str,
    gap: timedelta,
    keys: list[str],
    measures: Measures,
    delay: timedelta,
) -> DataFrame:
    """Aggregate per run of events of one key that are at most ``gap`` apart."""
    window = F.session_window(ts, interval(gap))
    return _windowed(stream, ts, window, keys, measures, delay).select(
        *keys, *_bounds("session"), *measures
    )


def deduplicated(
    stream: DataFrame, ts: str, keys: list[str], delay: timedelta, thin: bool = False
) -> DataFrame:
    """Drop repeats of ``keys`` that arrive within ``delay`` of the first, in event time.

    A key is forgotten once the watermark has passed it, so state holds the keys of the
    last ``delay`` only. A repeat whose event time lies further off may pass again.

    All copies of a key meet in one task. Spark's operator sends it every copy; with ``thin``
    each map task first drops the repeats within an Arrow batch, so that a key with very many
    copies brings one row per batch. That takes every row through Python, and keys can't
    be structs then.
    """
    if thin:
        stream = stream.mapInArrow(_first_per_batch(keys), stream.schema)
    return stream.withWatermark(ts, interval(delay)).dropDuplicatesWithinWatermark(keys)


def _first_per_batch(keys: list[str]) -> Callable[[Iterator], Iterator]:
    def thin(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = pa.Table.from_batches([batch]).select(keys)
            rows = rows.append_column("_row", pa.array(np.arange(batch.num_rows)))
            first = rows.group_by(keys).aggregate([("_row", "min")])["_row_min"]
            yield batch if len(first) == batch.num_rows else batch.take(first.combine_chunks())

    return thin


def _windowed(
    stream: DataFrame,
    ts: str,
    window: Column,
    keys: list[str],
    measures: Measures,
    delay: timedelta,
) -> DataFrame:
    return (
        stream.withWatermark(ts, interval(delay))
        .groupBy(window.alias("_window"), *keys)
        .agg(*from_rows(measures))
    )


def _bounds(name: str) -> list[Column]:
    return [
        from_instant("_window.start").alias(f"{name}_start"),
        from_instant("_window.end").alias(f"{name}_end"),
    ]

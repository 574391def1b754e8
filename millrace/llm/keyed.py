"""Rows looked up by key with a Bloom filter first, so that only rows that may match are shuffled.

A join of a wide table with a few of its keys moves the whole table once those keys are too many to be
broadcast as rows. Their filter takes 16 bits a key and is the blocked one of :mod:`.spelling`. What
it lets through goes on to an exact join, so the filter never changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spelling import BITS_PER_WORD, FILTER_BYTES, LONGS, bits_of, block_of
from .wordhash import small

_KEYS = 4096
_BLOCK_BITS = 64 * LONGS
#: With fewer bits a key a filter lets through most of what it is asked for.
_LEAST_BITS = 4


def _hashes(keys: pa.Array) -> np.ndarray:
    return keys.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)


def _may_hold(keys: DataFrame, column: str, filter_bytes: int) -> Column | None:
    """Whether ``column`` may be among ``keys``; None for so many keys that a filter is of no use."""
    count = keys.count()
    if count * _LEAST_BITS > filter_bytes * 8:
        return None
    blocks = -(-count * BITS_PER_WORD // _BLOCK_BITS)
    blocks = np.array([max(1, min(blocks, filter_bytes * 8 // _BLOCK_BITS))], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, _KEYS):
            hashes = _hashes(batch.column(0))
            block = block_of(hashes, blocks) * LONGS
            for k in range(LONGS):
                bits = bits_of(hashes, k).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block + k), pa.array(bits)], ["place", "bits"]
                )

    placed = keys.mapInArrow(place, "place bigint, bits bigint")
    merged = placed.groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    longs = np.zeros(int(blocks[0]) * LONGS, np.int64)
    longs[merged["place"].to_numpy()] = merged["bits"].to_numpy()
    held = keys.sparkSession.sparkContext.broadcast(longs.view(np.uint64))

    @F.arrow_udf("boolean")
    def may_hold(key: pa.Array) -> pa.Array:
        hashes = _hashes(key)
        block = block_of(hashes, blocks) * LONGS
        found = np.ones(len(hashes), bool)
        for k in range(LONGS):
            bits = bits_of(hashes, k)
            found &= (held.value[block + k] & bits) == bits
        return pa.array(found)

    return may_hold(column)


def with_keys(df: DataFrame, keys: DataFrame, column: str, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """The rows of ``df`` whose ``column`` (bigint) may be one of ``keys``: all that are, few others.

    Meant to go before a join with ``keys``, a table that holds ``column`` and can be read again. A null
    key matches nothing. The filter has at most ``filter_bytes``; keys too many for that leave ``df``
    as it is. Runs jobs.
    """
    may_hold = _may_hold(keys.select(column).filter(F.col(column).isNotNull()), column, filter_bytes)
    return df if may_hold is None else df.filter(may_hold)


def without_keys(df: DataFrame, keys: DataFrame, column: str, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """The rows of ``df`` whose ``column`` (bigint) is none of ``keys``; those with a null are kept.

    Exact. Only rows that the filter can't tell from ``keys`` take part in a join. Otherwise as
    :func:`with_keys`.
    """
    keys = keys.select(column).filter(F.col(column).isNotNull())
    may_hold = _may_hold(keys, column, filter_bytes)
    if may_hold is None:
        return df.join(keys, column, "left_anti")
    left = df.filter(may_hold).join(keys, column, "left_anti")
    return df.filter(~may_hold).unionByName(left)

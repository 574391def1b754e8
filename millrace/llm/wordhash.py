"""Words and word shingles of Arrow text columns as arrays of 64-bit hashes.

Runs inside tasks, on a few megabytes of UTF-8 at a time. Words are runs of bytes other than
the six ASCII white-space characters, after A-Z were lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 2 << 20

_SEED = np.random.Generator(np.random.PCG64(20240229))
_LETTER = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> np.ndarray:
    steps = np.full(n, _BASE, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_POWERS = _powers(4096)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that all output bits depend on all input bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a task makes of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of the rows in them; null reads as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each; a longer row forms a range of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each row's words begin (one more at the end)."""
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if len(offsets) == 2 and len(data) > 2 * SLICE:
        return _long_row(data)
    return _hashes(data, offsets)


def _long_row(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    # One very long text is cut at white space, so that memory stays bounded.
    parts, at = [], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        parts.append(_hashes(data[at:end], np.array([0, end - at]))[0])
        at = end
    hashes = np.concatenate(parts)
    return hashes, np.array([0, len(hashes)])


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    where = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), where
    if lengths.max() > len(_POWERS):
        _POWERS = _powers(int(lengths.max()))
    begin = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(begin, lengths)
    sums = np.add.reduceat(_LETTER[data[inside]] * _POWERS[place], begin)
    return mix(sums ^ lengths.astype(np.uint64)), where


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words of one row, repeats included.

    A row with fewer words has its whole sequence as one shingle, and none without words.
    """
    if not len(words):
        return words
    size = min(size, len(words))
    count = len(words) - size + 1
    total = np.zeros(count, np.uint64)
    for k in range(size):
        total = (total + words[k : k + count]) * _BASE
        total ^= total >> np.uint64(29)
    return mix(total ^ np.uint64(size))

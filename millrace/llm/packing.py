"""Packing by power-of-two decomposition: pieces of binary length, equal lengths together.

A document of n tokens is cut into n // 2048 pieces of the full length and one piece for each
binary digit of the rest, largest first. Every piece is a sequence of its own, so that no
sequence crosses documents and none needs padding; sequences are numbered by length, longest
first, so that batches of one shape are contiguous.
"""

from __future__ import annotations

import os
import sys
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import written
from .wordhash import small

END = (1).to_bytes(4, "little")
LONGEST = 2048
_KEPT = 300_000
_LONG_CHUNK = 100
_BATCH_BYTES = 4 << 20

# Byte-level vocabularies write printable bytes as themselves, the others from U+0100 on.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHER = [b for b in range(256) if b not in _PLAIN]
_BYTE = {b: chr(b) if b in _PLAIN else chr(256 + _OTHER.index(b)) for b in range(256)}


class ChunkIds(dict):
    """Token ids of chunks between white space, as little-endian 32-bit bytes.

    The tokenizer drops white space and never merges across it, so the ids of a text are those
    of its chunks, one after the other. The first ``_KEPT`` chunks are remembered; being met
    first, they are mostly the frequent ones. So are lower-case words, which many chunks share.
    """

    def __init__(self, file: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self._encode(chunk)
        if len(self) < _KEPT and len(chunk) <= _LONG_CHUNK:
            self[chunk] = ids
        return ids

    def _encode(self, chunk: str) -> bytes:
        core = chunk.rstrip(".,")
        if core.isalpha() and max(core) < "\u0250":
            # Latin letters are one piece for the vocabulary, whatever stands after them.
            low = core.lower()
            if low.isalpha():
                ids = self.words.get(low)
                if ids is None:
                    written = low if low.isascii() else "".join(_BYTE[b] for b in low.encode())
                    ids = _bytes([token.id for token in self.model.tokenize(written)])
                    if len(self.words) < _KEPT and len(low) <= _LONG_CHUNK:
                        self.words[low] = ids
                return ids + self[chunk[len(core) :]] if len(core) < len(chunk) else ids
        return _bytes(self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    def of(self, text: str) -> bytes:
        chunks = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.__getitem__, chunks))


@lru_cache(maxsize=1)
def _chunk_ids(file: str) -> ChunkIds:
    """One per Python worker, so that its tasks share what is remembered."""
    return ChunkIds(file)


def _bytes(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Full pieces, then the binary digits of the rest, largest first."""
    rest = n % longest
    digits = [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]
    return [longest] * (n // longest) + digits


_SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint, "
    "_task bigint, _nth bigint"
)


def pieces(docs: DataFrame, tokenizer: str, longest: int = LONGEST) -> DataFrame:
    """The pieces of every text, with the task that cut them and their place in it by length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task = _chunk_ids(tokenizer), TaskContext.get().partitionId()
        places: Counter[int] = Counter()
        for batch in small(batches):
            rows: list[tuple] = []
            held = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = known.of(text or "") + END
                held += len(ids)
                n, at = len(ids) // 4, 0
                for length in lengths(n, longest):
                    part = ids[4 * at : 4 * (at + length)]
                    rows.append((key, at, length, part, crc32(part), n, task, places[length]))
                    places[length] += 1
                    at += length
                if held >= _BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            yield _batch(rows)

    return docs.select("doc_id", "text").mapInArrow(cut, _SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 8
    names = [field.split()[0] for field in _SCHEMA.split(", ")]
    kinds = [pa.binary() if name == "ids" else pa.int64() for name in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def packed(
    docs: DataFrame, tokenizer: str, longest: int = LONGEST, with_ids: bool = True
) -> DataFrame:
    """Return one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``docs`` has doc_id and text; other columns are ignored. A null or empty text is the end
    token alone, one piece of length 1. ``ids`` (32-bit little-endian) come too unless
    ``with_ids`` is off. sequence_id counts sequences from 0, longer ones first and within
    a length in the order of the input; repeated rows get sequences of their own and a null
    doc_id is kept. An empty table gives an empty result. Needs folder ``spark.checkpoint.dir``;
    runs jobs. Ids are written once and never shuffled.
    """
    rows = pieces(docs, tokenizer, longest)
    rows = written(rows if with_ids else rows.drop("ids"), "pieces")
    counts = rows.groupBy("length", "_task").agg(F.count("*").alias("_count"))
    longer = counts.groupBy("length").agg(F.sum("_count").alias("_all"))
    # One row per length here, and one per length and task of the write below.
    before = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    longer = longer.select("length", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_from"))
    earlier = Window.partitionBy("length").orderBy("_task")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_inside")
    starts = counts.select("length", "_task", inside).join(longer, "length")
    # Written, so that Spark knows its size: broadcast below the session's limit, else shuffled.
    rows = rows.join(written(starts, "starts"), ["length", "_task"])
    return rows.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("_from") + F.col("_inside") + F.col("_nth")).cast("bigint").alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
        *(["ids"] if with_ids else []),
    )

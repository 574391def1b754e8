"""Spelling variants of a corpus vocabulary, found with Bloom filters over its words.

Near words differ by one inserted, deleted or replaced code point. Every word generates the words
with one code point replaced or deleted (an insertion is the other word's deletion) and looks them
up in blocked Bloom filters, one for each length, which all tasks hold. Only what a filter lets
through is shuffled, to an exact join with the vocabulary that drops the false positives.

A key sets two bits in each of the four longs of one block, so that one block answers for it.
Hashes are sums of letter * B**place, from which the hash of an edited word follows without
building it.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import written
from .wordhash import mix

LETTERS = ascii_lowercase + "".join(map(chr, range(0xC0, 0x100)))
BITS_PER_WORD = 16
LONGS = 4
FILTER_BYTES = 32 << 20
_POSITIONS = 4096
_WORDS = 4096

_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_U = np.uint64


def vocabulary(docs: DataFrame, every: int = 97, least: int = 3, shortest: int = 5) -> DataFrame:
    """``word, n``: letter runs of all texts, A-Z lower-cased, and how often they occur.

    Of a run for which ``every`` divides h = crc32 of ``<doc_id>:<run>``, the code point h % length
    is deleted, which makes variants. A null doc_id is written as nothing. Words have at least
    ``shortest`` code points and ``least`` occurrences. A null text has no words.
    """
    lower = F.translate("text", ascii_uppercase, ascii_lowercase)
    runs = F.regexp_extract_all(lower, F.lit("([a-zÀ-ÿ]+)"), F.lit(1))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    each = docs.select(key.alias("_key"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("_key", F.lit(":"), "run").cast("binary"))
    at = (F.col("_h") % F.char_length("run")).cast("int")
    cut = F.concat(
        F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run"))
    )
    word = F.when(F.col("_h") % every == 0, cut).otherwise(F.col("run"))
    words = each.withColumn("_h", h).select(word.alias("word"))
    words = words.filter(F.char_length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


class Words:
    """Code points and hashes of the words of an Arrow column."""

    def __init__(self, words: pa.Array) -> None:
        texts = words.to_pylist()
        self.texts = texts
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(_U)
        self.word = np.repeat(np.arange(len(texts)), self.lengths)
        self.place = np.arange(len(self.points)) - self.starts[self.word]
        longest = int(self.lengths.max()) if len(texts) else 0
        powers = np.full(longest + 1, _B, _U)
        powers[0] = 1
        self.power = np.multiply.accumulate(powers)[self.place]
        self.until = np.cumsum(self.points * self.power, dtype=_U)

    def before(self, at: np.ndarray) -> np.ndarray:
        """The sum over all points before ``at``."""
        return np.where(at > 0, self.until[at - 1], _U(0))

    def hashes(self) -> np.ndarray:
        return self.before(self.ends) - self.before(self.starts)

    def deletions(self) -> tuple[np.ndarray, np.ndarray]:
        """Points to delete, one of each run of equal ones, and the hash of what is left."""
        same = np.zeros(len(self.points), bool)
        same[1:] = (self.points[1:] == self.points[:-1]) & (self.place[1:] > 0)
        at = np.flatnonzero(~same)
        start, end = self.starts[self.word[at]], self.ends[self.word[at]]
        head = self.before(at) - self.before(start)
        tail = self.before(end) - self.until[at]
        return at, head + tail * _B_INVERSE

    def replacements(self, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Points to replace, the letters to put there, and hashes, some thousand points at a time."""
        whole = self.hashes()
        for low in range(0, len(self.points), _POSITIONS):
            at = np.arange(low, min(low + _POSITIONS, len(self.points)))
            change = (letters[None, :] - self.points[at][:, None]) * self.power[at][:, None]
            hashes = whole[self.word[at]][:, None] + change
            row, letter = np.nonzero(change)
            yield at[row], letter, hashes[row, letter]


def block_of(hashes: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    return (((mix(hashes) >> _U(32)) * blocks.astype(_U)) >> _U(32)).astype(np.int64)


def bits_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """The two bits that a hash sets in long ``k`` of its block."""
    own = mix(hashes + _U((k + 1) * int(_B) % (1 << 64)))
    return (_U(1) << (own & _U(63))) | (_U(1) << (own >> _U(58)))


def turn(hashes: np.ndarray, turns: int) -> np.ndarray:
    """In which of several rounds a word is looked up; independent of its block."""
    return (mix(hashes ^ _B) % _U(turns)).astype(np.int64)


class Filters:
    """One blocked filter per word length, in one array; a missing length holds nothing."""

    def __init__(self, lengths: np.ndarray, blocks: np.ndarray, longs: np.ndarray) -> None:
        self.lengths, self.blocks, self.longs = lengths, blocks, longs
        self.first = np.cumsum(blocks) - blocks

    def shard(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The filter of each length, and whether there is one."""
        at = np.minimum(np.searchsorted(self.lengths, lengths), max(len(self.lengths) - 1, 0))
        return at, (self.lengths[at] == lengths) if len(self.lengths) else np.zeros(len(at), bool)

    def may_hold(self, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Positions of the keys that the filters let through."""
        at, known = self.shard(lengths)
        left = np.flatnonzero(known)
        where = (self.first[at[left]] + block_of(hashes[left], self.blocks[at[left]])) * LONGS
        for k in range(LONGS):
            bits = bits_of(hashes[left], k)
            hit = (self.longs[where + k] & bits) == bits
            left, where = left[hit], where[hit]
        return left


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _WORDS):
            yield batch.slice(at, _WORDS)


def filters(words: DataFrame, sizes: list[tuple[int, int]], turns: int, nth: int) -> Filters:
    """Filters over the words of one round, put together from bits that tasks have merged.

    ``sizes`` has (length, words) in order. At most ``FILTER_BYTES`` come to the driver.
    """
    lengths = np.array([length for length, _ in sizes], np.int64)
    blocks = np.array([-(-n * BITS_PER_WORD // (64 * LONGS * turns)) for _, n in sizes], np.int64)
    empty = Filters(lengths, blocks, np.zeros(0, _U))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            found = Words(batch.column(0))
            hashes = found.hashes()
            own = turn(hashes, turns) == nth
            at, _ = empty.shard(found.lengths[own])
            block = (empty.first[at] + block_of(hashes[own], blocks[at])) * LONGS
            for k in range(LONGS):
                bits = bits_of(hashes[own], k).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block + k), pa.array(bits)], ["place", "bits"]
                )

    placed = words.select("word").mapInArrow(place, "place bigint, bits bigint")
    merged = placed.groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    longs = np.zeros(int(blocks.sum()) * LONGS, np.int64)
    longs[merged["place"].to_numpy()] = merged["bits"].to_numpy()
    return Filters(lengths, blocks, longs.view(_U))


_EDITED = "word string, n bigint, other string, shorter boolean"


def edits(words: DataFrame, found: Filters, letters: str, turns: int, nth: int) -> DataFrame:
    """``word, n, other, shorter``: edits of ``words`` (word, n) that the filters may hold."""
    held = words.sparkSession.sparkContext.broadcast(found)
    alphabet = np.array([ord(c) for c in letters], _U)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            own = Words(batch.column(0))
            rows, others, shorter = [], [], []

            def let_through(at, hashes, lengths) -> np.ndarray:
                mine = np.flatnonzero(turn(hashes, turns) == nth) if turns > 1 else slice(None)
                kept = held.value.may_hold(lengths[mine], hashes[mine])
                return kept if turns == 1 else mine[kept]

            at, hashes = own.deletions()
            for k in let_through(at, hashes, own.lengths[own.word[at]] - 1):
                text, p = own.texts[own.word[at[k]]], own.place[at[k]]
                rows.append(own.word[at[k]])
                others.append(text[:p] + text[p + 1 :])
                shorter.append(True)
            for at, letter, hashes in own.replacements(alphabet):
                for k in let_through(at, hashes, own.lengths[own.word[at]]):
                    text, p = own.texts[own.word[at[k]]], own.place[at[k]]
                    rows.append(own.word[at[k]])
                    others.append(text[:p] + letters[letter[k]] + text[p + 1 :])
                    shorter.append(False)
            which = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(which),
                    batch.column(1).take(which),
                    pa.array(others, pa.string()),
                    pa.array(shorter, pa.bool_()),
                ],
                ["word", "n", "other", "shorter"],
            )

    return words.select("word", "n").mapInArrow(edit, _EDITED)


def near_words(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``word, n, other, other_n`` for every ordered pair of near words of ``words`` (word, n).

    Filters take 16 bits a word. Where that exceeds ``filter_bytes`` words are looked up in
    as many rounds, each with the filters of a part of the vocabulary chosen by hash.
    """
    by_length = words.groupBy(F.char_length("word").alias("length")).agg(F.count("*").alias("words"))
    sizes = sorted((r.length, r.words) for r in by_length.collect())
    used = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct()
    letters = "".join(sorted(r.c for r in used.collect() if r.c))  # letters of a bounded alphabet
    total = sum(n for _, n in sizes)
    turns = max(1, -(-total * BITS_PER_WORD // 8 // filter_bytes))
    positives = None
    for nth in range(turns):
        part = edits(words, filters(words, sizes, turns, nth), letters, turns, nth)
        positives = part if positives is None else positives.unionByName(part)
    known = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = written(positives.join(known, "other"), "near")
    back = pairs.filter("shorter").select(
        F.col("other").alias("word"),
        F.col("other_n").alias("n"),
        F.col("word").alias("other"),
        F.col("n").alias("other_n"),
    )
    return pairs.drop("shorter").select("word", "n", "other", "other_n").unionByName(back)


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where ``forms`` (word, form) lead in the end, by doubling steps.

    A form occurs at least twice as often as its word, so there are no circles, and the number
    of rounds grows with the logarithm of the logarithm of the largest count.
    """
    steps = written(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = steps.join(ahead, "root", "left")
        moved = written(
            moved.select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "steps",
        )
        steps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return steps


def spelling_groups(
    docs: DataFrame,
    every: int = 97,
    least: int = 3,
    shortest: int = 5,
    filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """Return ``word, form, root, n, n_near, form_n`` for every word of ``docs`` (doc_id, text).

    Words are those of :func:`vocabulary`. form is the near word with the largest n, ties to
    the smallest in code-point order, if that n is at least twice the word's own; else null, as is
    form_n. root follows forms to the last, and is the word itself without one. n_near counts near words.
    Null and empty texts have no words; repeated rows count again; other columns are ignored. An
    empty table gives an empty result. Filters of at most ``filter_bytes`` are broadcast. Needs
    folder ``spark.checkpoint.dir``; runs jobs.
    """
    words = written(vocabulary(docs, every, least, shortest), "words")
    near = near_words(words, filter_bytes).groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"),
    )
    common = -F.col("best.less") >= 2 * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word",
        F.when(common, F.col("best.form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(common, -F.col("best.less")).cast("bigint").alias("form_n"),
    )
    rows = written(rows, "forms")
    ends = roots(rows.filter(F.col("form").isNotNull()))
    rows = rows.join(ends, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

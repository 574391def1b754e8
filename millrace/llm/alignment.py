"""Alignment of two tokenizers' tokens by lockstep merging, with corpus-wide counts of id pairs.

A batch of texts is tokenized by both, which gives two sorted columns of byte ends. One vector
holds a pointer into each column for every text of the batch (for long ones, for every run of
``LANE`` tokens); a step puts out one link for all of them, notes a cut where both tokens end,
advances the pointer or pointers whose token ends first, and drops what is finished from the vector.

Links are counted by id pair over the corpus. Pairs above a count are few by definition; those
are looked up in a broadcast table of at most ``HEAVY`` rows, and only the links of all other pairs
are shuffled, so that a pair that a third of the texts holds never meets in one task.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import written

LANE = 64
HEAVY = 1 << 18
_PIECE = 1 << 20
_PASS_CHARS = 2 << 20
_TOGETHER = 4096
_KEPT = 300_000
_KEPT_CHARS = 16 << 20

# A space between two of these (none of them white space or a combining mark) always begins a
# token of both kinds, so what lies between such spaces is tokenized for itself.
_PLAIN = "[!-~¡-˿]"
_GAP = re.compile(f" (?={_PLAIN})(?<={_PLAIN} )")
_WORD = re.compile(f"{_PLAIN}+").fullmatch
# Fixed value: how byte-level BPE cuts texts before it merges.
_PRE_TOKENS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


class Ragged:
    """Rows of integers in one growing array."""

    def __init__(self) -> None:
        self.flat, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64)
        self.rows = 0

    def extend(self, flat: np.ndarray, ends: np.ndarray) -> None:
        """Add rows, one after the other in ``flat``, each up to its end."""
        at, rows = int(self.ends[self.rows]), self.rows
        self.flat = _with_room(self.flat, at + len(flat))
        self.ends = _with_room(self.ends, rows + 1 + len(ends))
        self.flat[at : at + len(flat)] = flat
        self.ends[rows + 1 : rows + 1 + len(ends)] = at + ends
        self.rows += len(ends)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen rows one after the other, and how long each is."""
        starts = self.ends[which]
        counts = self.ends[which + 1] - starts
        begin = np.cumsum(counts) - counts
        return self.flat[np.repeat(starts - begin, counts) + np.arange(counts.sum())], counts


def _with_room(array: np.ndarray, size: int) -> np.ndarray:
    while len(array) < size:
        array = np.concatenate([array, np.zeros_like(array)])
    return array


class TwoTokenizers:
    """Both tokenizations of chunks of text, which are remembered within a bound."""

    def __init__(self, file_a: str, file_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(file_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        other = [b for b in range(256) if b not in printable]
        byte = {chr(b) if b in printable else chr(256 + other.index(b)): b for b in range(256)}
        self.bytes_a = [
            bytes(byte.get(c, 63) for c in self.a.id_to_token(i) or "")
            for i in range(self.a.get_vocab_size())
        ]
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.length_a = np.array([len(t) for t in self.bytes_a])
        self.length_b = np.array([len(t) for t in self.bytes_b])
        # Where a piece may hold a space after something else, texts can't be cut at spaces.
        self.gap = None if any(" " in t.decode(errors="ignore").lstrip(" ") for t in self.bytes_b) else _GAP
        self.quick = self._quick(file_a)
        self.forget()

    def _quick(self, file_a: str):
        """The same byte-level BPE in another library, where merges come in the order of ids."""
        import tiktoken

        with open(file_a) as opened:
            merges = json.load(opened)["model"]["merges"]
        parts = ("".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges)
        if any(self.a.id_to_token(256 + n) != part for n, part in enumerate(parts)):
            return None
        ranks = {t: i for i, t in enumerate(self.bytes_a[: 256 + len(merges)])}
        return tiktoken.Encoding("a", pat_str=_PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids_a, self.ids_b = Ragged(), Ragged()
        self.inexact: set[int] = set()
        self.held = 0

    def chunks(self, text: str) -> list[str]:
        return self.gap.split(text) if self.gap else [text]

    def learn(self, chunks: list[str]) -> np.ndarray:
        """The number of each chunk; chunks not known yet are tokenized first."""
        new = list(set(chunks).difference(self.known))
        together = [c for c in new if _WORD(c)] if self.gap and self.quick else []
        single = [c for c in new if not _WORD(c)] if together else new
        for at in range(0, len(together), _TOGETHER):
            block = together[at : at + _TOGETHER]
            if not self._learn_together(block):
                self._learn_each(block)
        self._learn_each(single)
        return np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))

    def _learn_together(self, chunks: list[str]) -> bool:
        """Tokenize chunks as one text; False where its tokens are not its bytes."""
        text = " ".join(chunks)
        whole = (" " + text).encode()
        a, b = self.quick.encode_ordinary(" " + text), self.b.encode(text, num_threads=1)
        if not self.joined_a(a) == whole == self.joined_b(b):
            return False
        sizes = [len(c) for c in chunks] if len(whole) == len(text) + 1 else [len(c.encode()) for c in chunks]
        until = np.cumsum(np.array(sizes) + 1)
        for ids, length, rows in ((a, self.length_a, self.ids_a), (b, self.length_b, self.ids_b)):
            ids = np.array(ids, np.int32)
            rows.extend(ids, np.searchsorted(np.cumsum(length[ids]), until) + 1)
        self._remember(chunks)
        return True

    def _learn_each(self, chunks: list[str]) -> None:
        if not chunks:
            return
        a = self.a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)
        a, b = [x.ids for x in a], self.b.encode(chunks, num_threads=1)
        first = len(self.known)
        for n, (chunk, left, right) in enumerate(zip(chunks, a, b)):
            if not self.joined_a(left) == (" " + chunk).encode() == self.joined_b(right):
                self.inexact.add(first + n)
        for ids, rows in ((a, self.ids_a), (b, self.ids_b)):
            flat = np.array(list(chain.from_iterable(ids)), np.int32)
            rows.extend(flat, np.cumsum([len(x) for x in ids]))
        self._remember(chunks)

    def _remember(self, chunks: list[str]) -> None:
        first = len(self.known)
        self.known.update(zip(chunks, range(first, first + len(chunks))))
        self.held += sum(map(len, chunks))

    def joined_a(self, ids) -> bytes:
        return b"".join(map(self.bytes_a.__getitem__, ids))

    def joined_b(self, ids) -> bytes:
        return b"".join(map(self.bytes_b.__getitem__, ids))

    def bound(self) -> None:
        if len(self.known) > _KEPT or self.held > _KEPT_CHARS:
            self.forget()


@lru_cache(maxsize=1)
def _tokenizers(file_a: str, file_b: str) -> TwoTokenizers:
    return TwoTokenizers(file_a, file_b)


def lockstep(
    end_a: np.ndarray, end_b: np.ndarray, first: np.ndarray, last: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (A token, B token) and cuts (A token, B token) of many lanes at once.

    ``end_a`` and ``end_b`` are byte ends over all texts, one after the other. A lane goes from
    A token ``first`` up to ``last``, exclusive; it starts with the B token that covers its first byte.
    """
    i, last = first.copy(), last.copy()
    begin = np.where(i > 0, end_a[i - 1], 0)
    j = np.searchsorted(end_b, begin, "right")
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(i):
        at_a, at_b = end_a[i], end_b[j]
        links_a.append(i), links_b.append(j)
        both = at_a == at_b
        cuts_a.append(i[both]), cuts_b.append(j[both])
        i, j = i + (at_a <= at_b), j + (at_b <= at_a)
        open_ = i < last
        if not open_.all():
            i, j, last = i[open_], j[open_], last[open_]

    def one(parts: list[np.ndarray]) -> np.ndarray:
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    return one(links_a), one(links_b), np.sort(one(cuts_a)), np.sort(one(cuts_b))


@lru_cache(maxsize=4)
def _digits(largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of all numbers below a power of ten, one row per place, and how many there are."""
    places = len(str(largest))
    numbers = np.arange(10**places)
    counts = np.maximum(1, sum(numbers >= 10**k for k in range(places)))
    power = counts - 1 - np.arange(places)[:, None]
    return (numbers // 10 ** np.maximum(power, 0) % 10 + 48).astype(np.uint8), counts


def group_text(
    ids_a: np.ndarray, ids_b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray
) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` over all groups, and the end of each group in it.

    Assumes that the last tokens of both columns end a group.
    """
    n_a, n_b = len(ids_a), len(ids_b)
    ends_a, ends_b = np.zeros(n_a, bool), np.zeros(n_b, bool)
    ends_a[cuts_a], ends_b[cuts_b] = True, True
    group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    earlier_b = np.concatenate([[0], cuts_b + 1])
    place_a = np.arange(n_a) + earlier_b[group_a]
    place_b = np.arange(n_b) + (cuts_a + 1)[group_b]
    ids, sign = np.empty(n_a + n_b, np.int32), np.empty(n_a + n_b, np.uint8)
    ids[place_a], ids[place_b] = ids_a, ids_b
    sign[place_a] = np.where(ends_a, ord("|"), ord(","))
    sign[place_b] = np.where(ends_b, ord(";"), ord(","))
    digits, counts = _digits(int(ids.max()))
    counts = counts[ids]
    ends = np.cumsum(counts + 1)
    out = np.empty(int(ends[-1]), np.uint8)
    at = ends - counts - 1
    out[at] = digits[0][ids]
    for k in range(1, len(digits)):
        more = np.flatnonzero(counts > k)
        out[at[more] + k] = digits[k][ids[more]]
    out[ends - 1] = sign
    return out.tobytes(), ends[place_b[cuts_b]]


class _Document:
    """What is known of one text, of which a long one is aligned piece by piece."""

    __slots__ = ("key", "n_a", "n_b", "groups", "links", "digest", "pairs", "times", "open")

    def __init__(self, key: int | None) -> None:
        self.key, self.n_a, self.n_b, self.groups, self.links = key, 0, 0, 0, 0
        self.digest, self.pairs, self.times = None, [], []
        self.open = True


def _pieces(tokenizers: TwoTokenizers, text: str) -> Iterator[str]:
    """A text cut at gaps into pieces of about ``_PIECE`` code points."""
    at = 0
    while tokenizers.gap and len(text) - at > _PIECE:
        gap = tokenizers.gap.search(text, at + _PIECE)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:] if at else text


def _same_bytes(tokenizers: TwoTokenizers, text: str, numbers: np.ndarray) -> bool:
    """Whether a text's joined tokens are its bytes, where a chunk of it is not exact."""
    whole = (" " + text).encode()
    a, _ = tokenizers.ids_a.take(numbers)
    b, _ = tokenizers.ids_b.take(numbers)
    return tokenizers.joined_a(a) == whole == tokenizers.joined_b(b)


def _align(tokenizers: TwoTokenizers, units: list[tuple[_Document, str]]) -> None:
    """Add the pieces of texts in ``units`` to their documents, all in one lockstep pass."""
    chunks, sizes = [], []
    for _, text in units:
        parts = tokenizers.chunks(text)
        chunks += parts
        sizes.append(len(parts))
    numbers = tokenizers.learn(chunks)
    ends = np.cumsum(sizes)
    odd = np.isin(numbers, list(tokenizers.inexact)) if tokenizers.inexact else np.zeros(0, bool)
    for k in np.unique(np.searchsorted(ends, np.flatnonzero(odd), "right")):
        own = numbers[ends[k] - sizes[k] : ends[k]]
        if not _same_bytes(tokenizers, units[k][1], own):
            units[k][0].open = False
    alive = [k for k, (doc, _) in enumerate(units) if doc.open]
    if not alive:
        return
    numbers = np.concatenate([numbers[ends[k] - sizes[k] : ends[k]] for k in alive])
    chunk_ends = np.cumsum([sizes[k] for k in alive])
    ids_a, counts_a = tokenizers.ids_a.take(numbers)
    ids_b, counts_b = tokenizers.ids_b.take(numbers)
    until_a, until_b = np.cumsum(counts_a)[chunk_ends - 1], np.cumsum(counts_b)[chunk_ends - 1]
    end_a, end_b = np.cumsum(tokenizers.length_a[ids_a]), np.cumsum(tokenizers.length_b[ids_b])

    start_a = np.concatenate([[0], until_a[:-1]])
    lanes = -(-(until_a - start_a) // LANE)
    nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    first = np.repeat(start_a, lanes) + nth * LANE
    last = np.minimum(first + LANE, np.repeat(until_a, lanes))
    links_a, links_b, cuts_a, cuts_b = lockstep(end_a, end_b, first, last)

    unit = np.repeat(np.arange(len(alive)), until_a - start_a)
    n_links = np.bincount(unit[links_a], minlength=len(alive))
    n_groups = np.bincount(unit[cuts_a], minlength=len(alive))
    text, group_ends = group_text(ids_a, ids_b, cuts_a, cuts_b)
    text_ends = group_ends[np.cumsum(n_groups) - 1]
    width = len(tokenizers.length_a) * len(tokenizers.length_b)
    pair = ids_a[links_a].astype(np.int64) * len(tokenizers.length_b) + ids_b[links_b]
    keys, times = np.unique(unit[links_a] * width + pair, return_counts=True)
    key_unit = keys // width
    keys -= key_unit * width
    key_ends = np.searchsorted(key_unit, np.arange(len(alive)), "right")
    at = from_text = from_key = 0
    for at, k in enumerate(alive):
        doc = units[k][0]
        doc.n_a += int(until_a[at] - start_a[at])
        doc.n_b += int(until_b[at] - (until_b[at - 1] if at else 0))
        doc.groups += int(n_groups[at])
        doc.links += int(n_links[at])
        if doc.digest is None:
            doc.digest = sha256()
        else:
            doc.digest.update(b";")
        doc.digest.update(text[from_text : int(text_ends[at]) - 1])
        doc.pairs.append(keys[from_key : key_ends[at]])
        doc.times.append(times[from_key : key_ends[at]])
        from_text, from_key = int(text_ends[at]), int(key_ends[at])


_ALIGNED = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups_sha256 string, pairs array<bigint>, times array<bigint>, _row bigint"
)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))


def _batch(docs: list[_Document], first_row: int) -> pa.RecordBatch:
    none = np.zeros(0, np.int64)
    columns: list[list] = [[] for _ in range(8)]
    for doc in docs:
        if doc.open and doc.digest is not None:
            pairs, times = doc.pairs[0], doc.times[0]
            if len(doc.pairs) > 1:
                pairs, where = np.unique(np.concatenate(doc.pairs), return_inverse=True)
                times = np.bincount(where, np.concatenate(doc.times)).astype(np.int64)
            row = (doc.key, doc.n_a, doc.n_b, doc.groups, doc.links, doc.digest.hexdigest())
        else:
            row, pairs, times = (doc.key, 0, 0, 0, 0, ""), none, none
        for column, value in zip(columns, (*row, pairs, times)):
            column.append(value)
    arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.string())]
    arrays += [_lists(columns[6]), _lists(columns[7])]
    arrays.append(pa.array(np.arange(first_row, first_row + len(docs)), pa.int64()))
    names = [field.split()[0] for field in _ALIGNED.split(", ")]
    return pa.RecordBatch.from_arrays(arrays, names)


def aligned(docs: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """Per text its counts, the digest of its groups, and how often it links each id pair.

    A pair is written as A id * size of B's vocabulary + B id. ``_row`` numbers rows within the run.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = _tokenizers(file_a, file_b)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            done: list[_Document] = []
            units: list[tuple[_Document, str]] = []
            held = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc, text = _Document(key), text.as_py()
                done.append(doc)
                passed = False
                for piece in _pieces(tokenizers, text) if text else ():
                    units.append((doc, piece))
                    held += len(piece)
                    if held >= _PASS_CHARS:
                        _align(tokenizers, units)
                        tokenizers.bound()
                        units, held, passed = [], 0, True
                if not units and (passed or len(done) >= 1000):
                    yield _batch(done, row)
                    row += len(done)
                    done = []
            if units:
                _align(tokenizers, units)
                tokenizers.bound()
            if done:
                yield _batch(done, row)
                row += len(done)

    return docs.select("doc_id", "text").mapInArrow(align, _ALIGNED)


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """``pair, n, best`` over the corpus: links per id pair, and whether no A id has more for its B id."""
    each = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    counts = written(counts.withColumn("b", F.pmod("pair", F.lit(size_b))), "pairs")
    highest = written(counts.groupBy("b").agg(F.max("n").alias("top")), "highest")
    return counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def heavy_from(counts: DataFrame, most: int = HEAVY) -> int:
    """The least power of two so that at most ``most`` pairs have that many links or more."""
    bits = counts.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count("*").alias("pairs"))
    total, least = 0, 1 << 62
    for bits, pairs in sorted(((r.bits, r.pairs) for r in bits.collect()), reverse=True):
        total += pairs
        if total > most:
            break
        least = 1 << (bits - 1)
    return least


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    until = np.concatenate([[0], np.cumsum(values)])
    return (until[offsets[1:]] - until[offsets[:-1]]).astype(np.int64)


_KEPT_COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "_row"]


def align_texts(docs: DataFrame, file_a: str, file_b: str, heavy: int = HEAVY) -> DataFrame:
    """Align both tokenizations of every text of ``docs`` (doc_id, text; other columns are ignored).

    ``file_a`` is a byte-level BPE of the tokenizers library, which gets a space before the text;
    ``file_b`` a sentencepiece model that adds that space itself. Returns doc_id, n_a, n_b, n_groups,
    n_links, n_best, count_sum and groups_sha256, one row per row, repeated ones and null ids
    included. A text that is null or empty, or whose tokens of either kind do not join up to space +
    text, has no tokens: zeros and ''. Links of pairs tie for best together. A long text is aligned
    in pieces of about a million code points, cut where both kinds of tokens end. An empty table
    gives an empty result. Up to ``heavy`` pair counts are broadcast; the links of all other pairs are
    shuffled by pair. Needs folder ``spark.checkpoint.dir``; runs jobs.
    """
    import sentencepiece

    spark = docs.sparkSession
    size_b = len(sentencepiece.SentencePieceProcessor(model_file=file_b))
    rows = written(aligned(docs, file_a, file_b), "aligned")
    counts = written(pair_counts(rows, size_b), "counts")
    least = heavy_from(counts, heavy)
    table = counts.filter(F.col("n") >= least).toArrow()
    order = np.argsort(table["pair"].to_numpy())
    known = spark.sparkContext.broadcast(
        tuple(table[c].to_numpy()[order] for c in ("pair", "n", "best"))
    )

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = known.value
        for batch in batches:
            pairs, times = (batch.column(name).flatten().to_numpy() for name in ("pairs", "times"))
            offsets = batch.column("pairs").offsets.to_numpy()
            offsets = offsets - offsets[0]
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            linked = np.where(hit, times, 0)
            sums = _per_row(linked * n[at] if len(keys) else linked, offsets)
            bests = _per_row(linked * best[at] if len(keys) else linked, offsets)
            left = np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=batch.num_rows))])
            rest = [
                pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), pa.array(x[~hit], pa.int64()))
                for x in (pairs, times)
            ]
            kept = [batch.column(name) for name in _KEPT_COLUMNS]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(bests), pa.array(sums), *rest],
                [*_KEPT_COLUMNS, "n_best", "count_sum", "pairs", "times"],
            )

    kinds = {field.split()[0]: field for field in _ALIGNED.split(", ")}
    schema = ", ".join(
        [*(kinds[c] for c in _KEPT_COLUMNS), "n_best bigint, count_sum bigint", kinds["pairs"], kinds["times"]]
    )
    part = written(rows.mapInArrow(look_up, schema), "looked_up")
    rest = part.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    rest = rest.select("_row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rest = rest.join(counts.filter(F.col("n") < least), "pair")
    rest = rest.groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"),
        F.sum(F.col("times") * F.col("n")).alias("_sum"),
    )
    both = part.drop("pairs", "times").join(rest, "_row", "left")
    return both.select(
        *("doc_id n_a n_b n_groups n_links".split()),
        (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )



"""Language identification by prediction by partial matching over bytes, with frozen statistics.

Every language has counts of the bytes that followed each context of up to ``order`` bytes in
its training texts. A byte seen n times in a context with T bytes of d kinds costs
log2((T + d) / n) bits there; any other pays the escape log2((T + d) / d) and is coded in the
context that is one byte shorter, down to a flat choice of 256. Bytes seen in a longer context
are not excluded from the shorter ones. The language with the shortest code is predicted.

Every context of the training sample is kept, for every language. As the statistics are frozen, the
code length of a byte depends on the bytes before it and on itself alone. So there is one row of
costs, by language and in whole 1/65536 bits, for each string of up to ``order`` + 1 bytes seen in
any language, found by a sorted key; sums of integers are exact. A language's costs do not depend
on which other languages there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import written
from .tables import even_sample
from .wordhash import slices, small, text_buffers

UNKNOWN = "und"
_UNIT = 65536
_LENGTH = 56  # bits of a gram below those that tell the length of its context
_START = 0x20  # a text begins as if after spaces


@dataclass
class LanguageModel:
    languages: list[str]
    order: int
    grams: list[np.ndarray]  # by length of context: context and byte as one integer, sorted
    first: list[int]  # by length of context: the row of its first gram in costs
    costs: np.ndarray  # grams x languages: code length in 1/65536 bits
    contexts: list[np.ndarray]  # by length of context: the contexts, sorted
    escapes: list[np.ndarray]  # contexts x languages: what a byte never seen there costs more


def fit(labelled: DataFrame, order: int = 4, texts_per_language: int = 1000) -> LanguageModel:
    """Learn from ``labelled`` (doc_id, text, lang); null texts and languages are left out.

    The training sample is bounded: about ``texts_per_language`` rows of each language, drawn by
    a hash of doc_id and text, each as a whole; repeated rows count once, and rows without an id are
    not learned from. All contexts seen in them are kept. ``order`` is at most 6. Runs jobs; with nothing to learn from
    the model has no language.
    """
    labelled = labelled.filter("text is not null")
    sample = even_sample(labelled, "lang", ["doc_id", "text"], texts_per_language).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            data, offsets = text_buffers(batch.column(1))
            langs = np.array(batch.column(0).to_pylist(), object)
            for row, end in slices(offsets):
                part = langs[row:end]
                for lang in set(part):
                    rows = row + np.flatnonzero(part == lang)
                    buffer, ends = _padded(data, offsets, rows, order)
                    for k in range(order + 1):
                        grams = _grams(buffer, ends, k, order)
                        keys, n = np.unique(grams, return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([lang] * len(keys), pa.string()),
                                pa.array(keys | k << _LENGTH),
                                pa.array(n.astype(np.int64)),
                            ],
                            ["lang", "gram", "n"],
                        )

    counts = sample.mapInArrow(count, "lang string, gram bigint, n bigint")
    counts = written(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    languages = sorted(r.lang for r in counts.select("lang").distinct().collect())
    # One language at a time on the driver; each is bounded by the grams of its sample.
    seen = []
    for lang in languages:
        rows = counts.filter(F.col("lang") == lang).select("gram", "n").toArrow()
        gram, n = (rows[c].to_numpy() for c in ("gram", "n"))
        turn = np.argsort(gram)
        seen.append((gram[turn], n[turn]))
    return _tables(languages, seen, order)


def _padded(
    data: np.ndarray, offsets: np.ndarray, rows, order: int
) -> tuple[np.ndarray, np.ndarray]:
    """The texts of ``rows``, each after ``order`` spaces, and where each ends."""
    gap = np.full(order, _START, np.uint8)
    parts = []
    for row in rows:
        parts += [gap, data[offsets[row] : offsets[row + 1]]]
    ends = np.cumsum([order + offsets[row + 1] - offsets[row] for row in rows])
    return np.concatenate(parts), ends


def _grams(buffer: np.ndarray, ends: np.ndarray, k: int, order: int) -> np.ndarray:
    """Per byte of text, the k bytes before it and itself as one integer."""
    wide = buffer.astype(np.int64)
    total = wide.copy()
    for back in range(1, k + 1):
        total[back:] += wide[:-back] << (8 * back)
    text = np.ones(len(buffer), bool)
    begin = np.concatenate([[0], ends[:-1]])
    text[(begin[:, None] + np.arange(order)).ravel()] = False
    return total[text]


def _tables(
    languages: list[str], seen: list[tuple[np.ndarray, np.ndarray]], order: int
) -> LanguageModel:
    """``seen`` has the sorted grams of each language, marked by length, and their counts."""
    every = np.unique(np.concatenate([np.zeros(0, np.int64), *(gram for gram, _ in seen)]))
    costs = np.full((len(every), max(1, len(languages))), 8 * _UNIT, np.int32)
    model = LanguageModel(languages, order, [], [], costs, [], [])
    below, of_below, at = np.zeros(0, np.int64), np.zeros((0, costs.shape[1]), np.int32), 0
    for k in range(order + 1):
        end = int(np.searchsorted(every, (k + 1) << _LENGTH))
        grams = every[at:end] - (k << _LENGTH)
        contexts, context = np.unique(grams >> 8, return_inverse=True)
        escapes = np.zeros((len(contexts), costs.shape[1]), np.int32)
        shorter = np.searchsorted(below, grams & ((1 << 8 * k) - 1))
        for lang, (gram, n) in enumerate(seen):
            a, b = np.searchsorted(gram, [k << _LENGTH, (k + 1) << _LENGTH])
            mine = np.searchsorted(every, gram[a:b])
            total = np.bincount(context[mine - at], n[a:b], len(contexts))
            kinds = np.bincount(context[mine - at], minlength=len(contexts))
            known = kinds > 0
            escape = np.log2((total[known] + kinds[known]) / kinds[known])
            escapes[known, lang] = np.rint(escape * _UNIT)
            # A byte this language did not see here escapes to its own shorter context.
            costs[at:end, lang] = escapes[context, lang] + (of_below[shorter, lang] if k else 8 * _UNIT)
            here = context[mine - at]
            costs[mine, lang] = np.rint(np.log2((total + kinds)[here] / n[a:b]) * _UNIT)
        model.grams.append(grams)
        model.first.append(at)
        model.contexts.append(contexts)
        model.escapes.append(escapes)
        below, of_below, at = grams, costs[at:end], end
    return model


def code_lengths(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code length of every row in every language, rows x languages, in 1/65536 bits."""
    order, size = model.order, len(model.costs)
    result = np.zeros((len(offsets) - 1, model.costs.shape[1]), np.int64)
    for row, end in slices(offsets, 1 << 20):
        if offsets[end] - offsets[row] > 2 << 20:  # one very long text, in pieces
            for at in range(int(offsets[row]), int(offsets[end]), 1 << 20):
                piece = np.array([at, min(at + (1 << 20), int(offsets[end]))])
                before = data[max(int(offsets[row]), at - order) : at]
                result[row] += _piece(model, size, data, piece, before)[0]
            continue
        result[row:end] = _piece(model, size, data, offsets[row : end + 1], None)
    return result


def _nodes(model: LanguageModel) -> int:
    return sum(map(len, model.contexts))


def _piece(model, _, data, offsets, before) -> np.ndarray:
    order = model.order
    buffer, ends = _padded(data, offsets, range(len(offsets) - 1), order)
    if before is not None and len(before):
        buffer[order - len(before) : order] = before
    gram = _grams(buffer, ends, order, order)
    cost = np.zeros((len(gram), model.costs.shape[1]), np.int32)
    left = np.arange(len(gram))  # bytes not yet found behind a context
    for k in range(order, -1, -1):
        where, found = _find(model.grams[k], gram)
        cost[left[found]] += model.costs[model.first[k] + where[found]]
        left, gram = left[~found], gram[~found]
        if not len(left):
            break
        where, found = _find(model.contexts[k], gram >> 8)
        cost[left[found]] += model.escapes[k][where[found]]
        gram = gram & ((1 << 8 * k) - 1)
    cost[left] += 8 * _UNIT
    sums = np.zeros((len(offsets), cost.shape[1]), np.int64)
    texts = np.flatnonzero(np.diff(offsets))
    if len(texts):
        sums[texts] = np.add.reduceat(cost, (offsets[:-1] - offsets[0])[texts], axis=0, dtype=np.int64)
    return sums[:-1]


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each asked key is in sorted ``keys``, and whether it is there at all."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    where = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return where, keys[where] == asked


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Add lang_pred, score and bits_per_byte to ``docs`` (text); other columns pass through.

    The score is the share of the predicted language in the sum of 2 ** -code length, 0 to 1;
    of languages with equal codes the first in order is taken. A text that is null or has no
    letter, or any text where no language was learned, is ``und`` with score 0. Columns of these
    names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "bits_per_byte")]
    docs = docs.select(*names).withColumn(
        "_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    )
    text, letter = docs.columns.index("text"), docs.columns.index("_letter")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in small(batches):
            usable = batch.column(letter).to_numpy(zero_copy_only=False)
            langs, scores, bits = [None] * len(usable), np.zeros(len(usable)), [None] * len(usable)
            if model.languages and len(usable):
                data, offsets = text_buffers(batch.column(text))
                lengths = code_lengths(model, data, offsets) / _UNIT
                best = lengths.argmin(axis=1)
                least = lengths.min(axis=1)
                with np.errstate(under="ignore"):
                    scores = 1 / np.exp2(np.maximum(least[:, None] - lengths, -1074)).sum(axis=1)
                langs = [model.languages[i] for i in best]
                bits = least / np.maximum(1, np.diff(offsets))
            langs = [x if ok and x is not None else UNKNOWN for x, ok in zip(langs, usable)]
            known = np.array([x != UNKNOWN for x in langs], bool)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:letter],
                    pa.array(langs, pa.string()),
                    pa.array(np.where(known, scores, 0.0), pa.float64()),
                    pa.array([x if ok else None for x, ok in zip(bits, known)], pa.float64()),
                ],
                [*batch.schema.names[:letter], "lang_pred", "score", "bits_per_byte"],
            )

    schema = docs.drop("_letter").schema.add("lang_pred", "string")
    schema = schema.add("score", "double").add("bits_per_byte", "double")
    return docs.mapInArrow(score, schema)

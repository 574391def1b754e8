"""Toxicity by a linear classifier over character n-grams scaled by log-count ratios.

A text's features are the distinct n-grams of its code points, in lower case and with a space at both
ends, hashed to a fixed number of buckets. From labelled texts come the naive Bayes log-count ratio
r of every feature, log of (1/2 + texts of label 1 with it) / all such counts over the same for label
0, and a logistic regression over presence times r. A ratio is moved towards 0 by three times its
standard error, so that only what the counts make certain has a say; in long texts of a rare
label the many uncertain ones drown the few certain. A score is the regression's probability.
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
from .wordhash import small

SIZES = (4, 5, 6, 7, 8)
BUCKET_BITS = 20
ERRORS = 3.0
SMOOTHING = 0.5
_PIECE = 1 << 19
_TIMES = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class ToxicityModel:
    weights: np.ndarray  # by bucket; regression weight times r, 0 where r is 0
    bias: float


def pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of some texts at a time, with the row of each; long texts come in parts.

    Parts overlap by one less than the longest n-gram, so that no n-gram is lost. Null is empty.
    """
    held, rows, size = [], [], 0
    for row, data in enumerate(column.cast(pa.binary()).to_pylist()):
        text = f" {(data or b'').decode(errors='replace').lower()} "
        for at in range(0, max(1, len(text) - SIZES[-1] + 1), _PIECE):
            part = text[at : at + _PIECE + SIZES[-1] - 1]
            held.append(part)
            rows.append(row)
            size += len(part)
            if size >= _PIECE:
                yield _points(held, rows)
                held, rows, size = [], [], 0
    if held:
        yield _points(held, rows)


def _points(texts: list[str], rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    # Parts of one text must not be read across, so places count parts; rows come with them.
    part = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return points.astype(np.uint64), np.stack([part, np.array(rows)[part]])


def features(
    points: np.ndarray, rows: np.ndarray, among: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs, in order, for all buckets or those with ``among`` set."""
    part, row = rows
    keys, gram = [], np.zeros(len(points), np.uint64)
    for n in range(1, SIZES[-1] + 1):
        count = len(points) - n + 1
        if count <= 0:
            break
        gram = (gram[:count] + points[n - 1 :]) * _TIMES
        gram ^= gram >> np.uint64(29)
        if n in SIZES:
            bucket = ((gram * _TIMES) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            inside = part[:count] == part[n - 1 :]
            here = np.flatnonzero(inside if among is None else inside & among[bucket])
            keys.append((row[here] << BUCKET_BITS) | bucket[here])
    found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return found >> BUCKET_BITS, found & ((1 << BUCKET_BITS) - 1)


def found_in(column: pa.Array, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of all rows of a column."""
    keys = []
    for points, rows in pieces(column):
        row, bucket = features(points, rows, among)
        keys.append((row << BUCKET_BITS) | bucket)
    found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return found >> BUCKET_BITS, found & ((1 << BUCKET_BITS) - 1)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    per_label: int = 2000,
    rounds: int = 100,
    penalty: float = 0.001,
) -> ToxicityModel:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, label); other columns are ignored.

    The training sample is bounded: about ``per_label`` documents of each label, drawn by a hash of
    id and text, each text as a whole. Labels other than 0 and 1, and null ids, are left out, a null
    text is empty, repeated rows count once, and an id labelled both ways is learned both ways.
    Only ids are joined to labels; of the texts none but the sample's are shuffled. Every feature of
    the sample takes part whose ratio is certain, however many there are. The regression, with
    an L2 ``penalty`` and both labels weighing alike, is fitted on the driver to the sample's
    features. Without texts of both labels every score is the share of label 1, or 0.5 where there
    is none. Runs jobs.
    """
    labels = labels.filter("label in (0, 1)").select("doc_id", "label").distinct()
    labels = labels.join(docs.select("doc_id"), "doc_id", "left_semi")
    drawn = even_sample(written(labels, "labels"), "label", ["doc_id"], per_label)
    # Distinct ids, about per_label for each of two labels; an id may still have many texts.
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    sample = sample.select("label", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample = written(sample.dropDuplicates(["label", "doc_id", "text"]), "drawn")
    sample = even_sample(sample, "label", ["doc_id", "text"], per_label).select("label", "text")
    sample = written(sample.repartition(8), "labelled")
    buckets = 1 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int32)
        for batch in small(batches):
            label = np.array(batch.column(0).to_pylist(), np.int64)
            row, bucket = found_in(batch.column(1))
            for one in (0, 1):
                own = bucket[label[row] == one]
                total[one] += np.bincount(own, minlength=buckets).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    seen = np.zeros((2, buckets), np.int64)
    for found in sample.mapInArrow(count, "total binary").toLocalIterator():
        seen += np.frombuffer(found["total"], np.int32).reshape(2, buckets)
    ratios = log_count_ratios(seen)
    among = ratios != 0

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            row, bucket = found_in(batch.column(1), among)
            counts = np.bincount(row, minlength=batch.num_rows)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)),
                pa.array(bucket.astype(np.int32)),
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int32()), lists], ["label", "found"]
            )

    # Bounded by the sample; features whose ratio is 0 have no weight to be found.
    rows = sample.mapInArrow(pick, "label int, found array<int>").toArrow()
    return _regression(rows, ratios, rounds, penalty)


def log_count_ratios(seen: np.ndarray) -> np.ndarray:
    """From texts with a feature by label, the ratio of label 1, less three standard errors."""
    counts = SMOOTHING + seen
    share = counts / counts.sum(axis=1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    error = np.sqrt(1 / counts[0] + 1 / counts[1])
    return np.sign(ratio) * np.maximum(0, np.abs(ratio) - ERRORS * error)


def _regression(
    rows: pa.Table, ratios: np.ndarray, rounds: int, penalty: float
) -> ToxicityModel:
    label = rows["label"].to_numpy().astype(np.float64)
    model = ToxicityModel(np.zeros(len(ratios), np.float32), 0.0)
    share = label.mean() if len(label) else 0.5
    if share in (0, 1) or not len(label):
        model.bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return model
    found = rows["found"].combine_chunks()
    lengths = np.diff(found.offsets.to_numpy())
    used, at = np.unique(found.flatten().to_numpy(), return_inverse=True)
    row = np.repeat(np.arange(len(label)), lengths)
    scale = ratios[used]
    balance = np.where(label == 1, 0.5 / share, 0.5 / (1 - share)) / len(label)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(row, (scale * w[:-1])[at], minlength=len(label)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        right = np.where(label == 1, p, 1 - p)
        error = (p - label) * balance
        slope = np.bincount(at, error[row], minlength=len(used)) * scale + penalty * w[:-1]
        value = -(balance * np.log(right + 1e-12)).sum() + penalty / 2 * (w[:-1] @ w[:-1])
        return value, np.append(slope, error.sum())

    w = _least(loss, np.zeros(len(used) + 1), rounds)
    model.weights[used] = w[:-1] * scale
    model.bias = float(w[-1])
    return model


def _least(loss, w: np.ndarray, rounds: int, kept: int = 8) -> np.ndarray:
    """The minimum of a convex function by limited-memory quasi-Newton steps (L-BFGS)."""
    value, slope = loss(w)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, shares = slope.copy(), []
        for move, change in reversed(moves):
            shares.append((move @ way) / (move @ change))
            way -= shares[-1] * change
        if moves:
            move, change = moves[-1]
            way *= (move @ change) / (change @ change)
        else:
            way /= max(1.0, np.abs(way).sum())
        for (move, change), part in zip(moves, reversed(shares)):
            way += (part - (change @ way) / (move @ change)) * move
        step, gain = 1.0, slope @ way
        next_value, next_slope = loss(w - way)
        while next_value > value - 1e-4 * step * gain and step > 1e-6:
            step /= 2
            next_value, next_slope = loss(w - step * way)
        move, change = -step * way, next_slope - slope
        done = value - next_value < 1e-7 * max(1.0, abs(value))
        w, value, slope = w + move, next_value, next_slope
        if done:
            break
        if move @ change > 1e-12:
            moves = [*moves, (move, change)][-kept:]
    return w


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from 0.5 on) to ``docs`` (text); other columns pass.

    Whole texts are read, very long ones in parts. A null text is scored like an empty one. Equal
    texts have equal scores, and an empty table gives an empty result. Columns of these names are
    replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*(c for c in docs.columns if c not in ("score", "predicted")))
    place, names = docs.columns.index("text"), [*docs.columns, "score", "predicted"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        among = model.weights != 0
        for batch in small(batches):
            row, bucket = found_in(batch.column(place), among)
            z = model.bias + np.bincount(row, model.weights[bucket], minlength=batch.num_rows)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            added = [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(apply, f"{schema}, score double, predicted int")

"""Exact top-k inner products by an impact-ordered index, a block of vectors at a time.

Vectors are lists of whole numbers. The index cuts them into blocks. A block has its vectors by
falling length, which times a query's is the most that they can add up to, and for every
dimension its postings of highest impact, from either end, in order of value. A chunk of queries
first takes the postings of the dimensions with the highest impacts, and the k-th best of the vectors met
is a lower bound. A product in single precision then bounds the scores of all vectors that are long
enough, and those whose upper bound is below the k-th best score so far are proven out. The few
possible members left are scored exactly. A query keeps its best from block to block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import written

_EXACT = 1 << 53  # whole numbers below are exact as doubles, in which scores are summed
_SINGLE = 1 << 24  # and as floats
HEAD = 16  # postings kept of each end of a dimension
FIRST = 4  # dimensions of which a query takes postings to find its first bound
TILE = 512  # queries that meet a block in one product
CROWD = 16  # possible members for a query above which a whole product is the cheaper exact score
SPAN = 64  # vectors of a block whose bounds are looked at together
PART_BYTES = 64 << 20  # of the queries that one task holds, with their best
_INDEX = "block bigint, rows int, width int, ids binary, vectors binary, heads binary"


def whole(column: str, scale: int = 1024):
    """floor(scale * x) of every component as double; null where the vector takes no part.

    A finite component whose product with ``scale`` is no exact whole number (2**53 or more) is an error.
    """
    x = F.col(column)
    fine = x.isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf"))
    )
    wrong = F.raise_error(F.lit(f"a component of {column} is too large")).cast("bigint")

    def scaled(v):
        product = v.cast("double") * F.lit(float(scale))
        return F.when(F.abs(product) < float(_EXACT), F.floor(product)).otherwise(wrong)

    return F.when(fine, F.transform(x, scaled))


def build(vectors: DataFrame, block_rows: int = 2048) -> DataFrame:
    """The index of ``vectors`` (vec_id, vector of bigint): one row per block, written once.

    Null vectors and null ids are left out. Shorter vectors end in zeros. Rows are dealt to blocks by
    their place, so a repeated id fills no block. Runs jobs.
    """
    vectors = vectors.filter("vec_id is not null and vector is not null")
    blocks = max(1, -(-vectors.count() // block_rows))
    placed = vectors.withColumn("block", _part(blocks))

    def lay_out(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy().astype(np.int64)
        values, _ = _matrix(table["vector"].combine_chunks())
        turn = np.argsort(-_lengths(values), kind="stable")
        ids, values = ids[turn], _narrow(values[turn])
        order = np.argsort(values.T, axis=1, kind="stable").astype(np.int32)
        heads = np.stack([order[:, :HEAD], order[:, ::-1][:, :HEAD]])
        binary = [pa.array([x.tobytes()], pa.binary()) for x in (ids, values, heads)]
        columns = [pa.array([len(ids)], pa.int32()), pa.array([values.shape[1]], pa.int32())]
        return pa.Table.from_arrays(
            [pa.array([table["block"][0].as_py()], pa.int64()), *columns, *binary],
            ["block", "rows", "width", "ids", "vectors", "heads"],
        )

    rows = placed.select("block", "vec_id", "vector")
    return written(rows.groupBy("block").applyInArrow(lay_out, _INDEX), "impact-index")


def _part(parts: int):
    """One of ``parts`` for every row, evenly, by a hash of its place in the table."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts))


def _each(parts: int):
    """A row for every one of ``parts``."""
    return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))


def _matrix(rows: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The lists as rows of a matrix that end in zeros, and how long each is."""
    sizes = np.diff(rows.offsets.to_numpy())
    values = np.zeros((len(rows), max(1, int(sizes.max(initial=0)))), np.int64)
    values[np.arange(values.shape[1]) < sizes[:, None]] = rows.flatten().to_numpy()
    return values, sizes


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers in the fewest bytes of 2, 4 and 8."""
    low, high = int(values.min()), int(values.max())
    return values.astype(next(t for t in ("i2", "i4", "i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _lengths(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", values, values))


def _exact(values: np.ndarray) -> np.ndarray:
    """Whole numbers below 2**53 as floats where those hold them all, else as doubles."""
    largest = max(abs(int(values.min(initial=0))), abs(int(values.max(initial=0))))
    return values.astype(np.float32 if largest <= _SINGLE else np.float64)


def _products(left: np.ndarray, at: np.ndarray, right: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Exact products of rows ``at`` of ``left`` with rows ``row`` of ``right``."""
    out, step = np.empty(len(at)), max(1, (1 << 20) // left.shape[1])
    for k in range(0, len(at), step):
        a, b = left[at[k : k + step]], right[row[k : k + step]]
        np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64), out=out[k : k + step])
    return out


class Block:
    """One block of the index, as it is searched."""

    def __init__(self, row: dict) -> None:
        rows, width = row["rows"], row["width"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        values = np.frombuffer(row["vectors"], f"i{len(row['vectors']) // (rows * width)}").reshape(rows, width)
        self.exact = _exact(values)
        # Whole spans; what is added are zeros.
        self.coarse = np.zeros((-(-rows // SPAN) * SPAN, width), np.float32)
        self.coarse[:rows] = self.exact
        self.largest = float(np.abs(self.exact).max())
        self.lengths = _lengths(self.exact)
        # By end (0 the lowest values, 1 the highest) and dimension: rows of the postings, the first one's value.
        self.heads = np.frombuffer(row["heads"], np.int32).reshape(2, width, -1)
        self.ends = np.take_along_axis(self.exact, self.heads[:, :, 0], axis=0)

    def as_long_as(self, least: float) -> int:
        """How many vectors, which are the first ones, have that length."""
        return int(np.searchsorted(-self.lengths, -least, side="right"))


class Best:
    """Queries, and the k best vectors of each in the blocks that they have met."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, sizes: np.ndarray, exact: np.ndarray, k: int) -> None:
        self.rows, self.ids, self.sizes, self.exact, self.k = rows, ids, sizes, exact, k
        self.coarse = exact.astype(np.float32, copy=False)
        self.width = 0  # of the last block; what goes beyond takes no part
        self.scores = np.full((len(rows), k), -np.inf)  # falling, ties by id; -inf where there are fewer
        self.found = np.full((len(rows), k), np.iinfo(np.int64).max)

    def meet(self, block: Block) -> None:
        """Take those of the block's vectors with other ids that are among the k best."""
        width = block.exact.shape[1]
        if (more := width - self.exact.shape[1]) > 0:
            self.exact = np.pad(self.exact, ((0, 0), (0, more)))
            self.coarse = self.exact.astype(np.float32, copy=False)
        if width != self.width:
            self.width, part = width, self.exact[:, :width]
            self.largest = np.maximum(part.max(axis=1), -part.min(axis=1)).astype(np.float64)
            self.lengths = _lengths(part)
        over = self.largest * (block.largest * np.maximum(self.sizes, width)) >= _EXACT
        if over.any():
            raise OverflowError(f"scores of query {self.ids[over.argmax()]} may exceed 53 bits")
        for start in range(0, len(self.rows), TILE):
            self._meet(block, start, width)

    def _meet(self, block: Block, start: int, width: int) -> None:
        tile = slice(start, start + TILE)
        bar, length = self.scores[tile, -1], self.lengths[tile]
        # No vector shorter than bar / length reaches the bar; lengths are right to less than 1e-9.
        short = np.divide(bar, length, out=np.full(len(bar), np.inf), where=length > 0)
        rows = block.as_long_as(np.where(bar > 0, short, 0).min() * (1 - 1e-9))
        if not rows:
            return
        coarse = block.coarse[: -(-rows // SPAN) * SPAN] @ self.coarse[tile, :width].T
        # What rounding to single precision, of components and of sums, can change of a score.
        error = (width + 8) * 2.0**-23 * length * block.lengths[0]
        if np.isneginf(bar).any():  # then all rows were taken
            bar = np.maximum(bar, self._first(block, tile, coarse) - error)
        least = np.nextafter((bar - error).astype(np.float32), np.float32(-np.inf))
        spans = coarse.reshape(-1, SPAN, len(bar))
        span, at = np.nonzero(spans.max(axis=1) >= least)
        near, row = np.nonzero(spans[span, :, at] >= least[at, None])
        at, row = at[near], span[near] * SPAN + row
        at, row = at[row < rows], row[row < rows]
        if not len(at):
            return
        hit, at = np.unique(at, return_inverse=True)
        bar, asked = bar[hit], hit + start
        if len(at) > CROWD * len(hit):
            scores = self.exact[asked, :width].astype(np.float64) @ block.exact[:rows].T.astype(np.float64)
            scores[block.ids[:rows] == self.ids[asked, None]] = -np.inf
            if rows > self.k:
                bar = np.maximum(bar, np.partition(scores, rows - self.k, axis=1)[:, rows - self.k])
            at, row = np.nonzero(scores >= bar[:, None])
            scores = scores[at, row]
        else:
            scores = _products(self.exact[asked, :width], at, block.exact, row)
        # A bar of this block's own says nothing of ids, the k-th best so far does.
        last, ids, at, bar = self.scores[asked, -1][at], block.ids[row], asked[at], bar[at]
        fine = (scores > last) | ((scores == last) & (ids < self.found[at, -1]))
        fine &= (scores >= bar) & (ids != self.ids[at])
        if fine.any():
            self._take(at[fine], ids[fine], scores[fine])

    def _first(self, block: Block, tile: slice, coarse: np.ndarray) -> np.ndarray:
        """Each query's k-th best of the vectors in its postings of the highest impacts."""
        asked = self.exact[tile, : block.exact.shape[1]]
        impact = asked * np.where(asked > 0, block.ends[1], block.ends[0])
        few = min(FIRST, impact.shape[1])
        taken = np.argpartition(-impact, few - 1, axis=1)[:, :few]
        end = (np.take_along_axis(asked, taken, axis=1) > 0).astype(np.int8)
        rows = np.sort(block.heads[end, taken].reshape(len(asked), -1), axis=1)
        if rows.shape[1] < self.k:
            return np.full(len(asked), -np.inf)
        scores = coarse[rows, np.arange(len(asked))[:, None]].astype(np.float64)
        scores[:, 1:][rows[:, 1:] == rows[:, :-1]] = -np.inf
        scores[block.ids[rows] == self.ids[tile, None]] = -np.inf
        return np.partition(scores, rows.shape[1] - self.k, axis=1)[:, rows.shape[1] - self.k]

    def _take(self, asked: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge new vectors; ``asked`` has places of queries."""
        who, at = np.unique(asked, return_inverse=True)
        at = np.concatenate([np.repeat(np.arange(len(who)), self.k), at])
        ids = np.concatenate([self.found[who].ravel(), ids])
        scores = np.concatenate([self.scores[who].ravel(), scores])
        turn = np.lexsort((ids, -scores, at))
        first = np.searchsorted(at[turn], np.arange(len(who)))
        best = turn[first[:, None] + np.arange(self.k)]
        self.scores[who], self.found[who] = scores[best], ids[best]


def _joined(held: list[tuple[np.ndarray, ...]], k: int) -> Best:
    rows, ids, sizes = (np.concatenate([x[i] for x in held]) for i in range(3))
    kind = np.result_type(*(x[3] for x in held))
    exact, start = np.zeros((len(rows), max(x[3].shape[1] for x in held)), kind), 0
    for *_, one in held:
        exact[start : start + len(one), : one.shape[1]] = one
        start += len(one)
    return Best(rows, ids, sizes, exact, k)


def search(index: DataFrame, queries: DataFrame, k: int = 10, chunk_rows: int = 256) -> DataFrame:
    """Return ``query_id, rank, vec_id, score``: for every query its k best vectors of the index.

    ``queries`` has vec_id and vector; those with a null in either ask nothing. Indexed vectors with
    the query's own id are left out; a repeated row of the index counts once for each, and each row of
    a repeated query has ranks of its own. Ties go to the smaller vec_id. Missing components count as 0. A
    query gets fewer than k rows only where there are fewer others, and an empty index none. Scores
    that may not fit 53 bits are an error. A task holds one part of the queries, mostly all of them, and meets
    one slice of the blocks, one after another; chunks are shipped once for each slice and blocks once for
    each part. Needs folder ``spark.checkpoint.dir``; runs jobs.
    """
    queries = queries.filter("vec_id is not null and vector is not null")
    # Written, so that every use sees the same numbers.
    queries = written(queries.select("vec_id", "vector", F.monotonically_increasing_id().alias("row")), "asked")
    count, longest = queries.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    blocks, width = index.agg(F.coalesce(F.max("block") + 1, F.lit(1)), F.coalesce(F.max("width"), F.lit(1))).first()
    chunks = max(1, -(-count // chunk_rows))
    # Of a query: its components, exact and in single precision, its best, and the rest.
    parts = min(chunks, -(-count * (4 * max(longest, width) + 16 * k + 48) // PART_BYTES) or 1)
    # Four tasks for each core, unless there is too little for them.
    slices = max(1, min(blocks // 8, -(-4 * index.sparkSession.sparkContext.defaultParallelism // parts)))
    asked = queries.groupBy(F.pmod(F.xxhash64("row"), F.lit(chunks)).alias("chunk")).agg(
        F.collect_list(F.struct("row", "vec_id", "vector")).alias("asked")
    )
    asked = asked.withColumn("slice", _each(slices)).withColumn("part", F.col("chunk") % parts)
    index = index.withColumn("slice", F.col("block") % slices).withColumn("part", _each(parts))
    met = asked.unionByName(index, allowMissingColumns=True).withColumn(
        "cell", (F.col("part") * slices + F.col("slice")).cast("int")
    )
    met = met.select("cell", "chunk", "asked", "block", "rows", "width", "ids", "vectors", "heads")
    # The chunks of a cell, which have no block, come before its blocks.
    met = met.repartitionById(parts * slices, "cell").sortWithinPartitions("cell", F.col("block").asc_nulls_first())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, best = None, [], None
        for batch in batches:
            for place in range(batch.num_rows):
                one = batch.slice(place, 1)
                if one["cell"][0].as_py() != cell:
                    yield from results(best)
                    cell, held, best = one["cell"][0].as_py(), [], None
                if one["block"].null_count:
                    rows = one["asked"].flatten()
                    vectors, sizes = _matrix(rows.field("vector"))
                    held.append((rows.field("row").to_numpy(), rows.field("vec_id").to_numpy(), sizes, _exact(vectors)))
                    continue
                if held:
                    best, held = _joined(held, k), []
                if best:
                    best.meet(Block({x: one[x][0].as_py() for x in ("rows", "width", "ids", "vectors", "heads")}))
        yield from results(best)

    def results(best: Best | None) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(best.rows) if best else 0, TILE):
            at, nth = np.nonzero(np.isfinite(best.scores[start : start + TILE]))
            at += start
            scores = best.scores[at, nth].astype(np.int64)
            found = best.rows[at], best.ids[at], best.found[at, nth], scores
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in found], ["row", "query_id", "vec_id", "score"]
            )

    each = met.mapInArrow(find, "row bigint, query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (
        each.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )

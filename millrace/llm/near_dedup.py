"""Near duplicates by b-bit MinHash: low bits of minima, packed; candidates by bands; exact links.

A document's set is its distinct shingles of lower-cased words. Per set of equal documents
one representative goes on. Its 128 minima give 32 band keys of four minima each, and their
four low bits, packed into eight longs, the signature. Two different elements agree in their
low bits by chance with probability 1/16, so of two sets with similarity s an expected share of
s + (1 - s) / 16 of the positions agree, which :func:`similarity` corrects for.

Two sets at the limit of 0.8 share no band with probability (1 - 0.8**4)**32 = 5e-8.

Within a band bucket no pairs are listed. Every member is compared with the bucket's
smallest one; what that links is joined up by components. Only buckets in which members of
different components are left are looked at again, and there only members of different
components: in small buckets by a join that puts out the pairs whose signatures allow a
link, in large ones block by block, putting out confirmed links only. The members of a bucket's
largest component are not copied for that; the others go to each of its blocks. A signature
rules a pair out only 6.5 standard deviations below the limit. Every link is confirmed on full
sets of shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..workspace import written
from .components import components
from .keyed import with_keys, without_keys
from .wordhash import mix, shingle_hashes, slices, small, text_buffers, word_hashes

MINIMA = 128
BITS = 4
ROWS_PER_BAND = 4
BANDS = MINIMA // ROWS_PER_BAND
LONGS = MINIMA * BITS // 64
_BLOCK = 4096
_CACHE = 64 << 20

_DRAW = np.random.Generator(np.random.PCG64(7))
_FLIP = _DRAW.integers(0, 1 << 32, MINIMA, dtype=np.uint32)[:, None]
_TIMES = (_DRAW.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the 128 hash functions over a set of 64-bit hashes."""
    low = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(values), _BLOCK):
        block = (values[None, at : at + _BLOCK] ^ _FLIP) * _TIMES
        np.minimum(low, block.min(axis=1), out=low)
    return low


def packed(low: np.ndarray) -> np.ndarray:
    """The low four bits of the minima as four planes of 128 bits, two 64-bit integers each."""
    planes = (low[None, :] >> np.arange(BITS, dtype=np.uint32)[:, None]) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8), axis=1).reshape(-1).view(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.astype(np.uint64).reshape(BANDS, ROWS_PER_BAND)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS_PER_BAND):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k] + np.uint64(1))
    return key.view(np.int64)


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    data, offsets = text_buffers(column)
    for row, end in slices(offsets):
        hashes, where = word_hashes(data, offsets[row : end + 1])
        for k in range(end - row):
            yield np.unique(shingle_hashes(hashes[where[k] : where[k + 1]], words))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """The rows of ``docs`` with ``n_shingles, set_key, signature, bands``, the last three null if
    empty, and a number for the row, ``row``."""
    docs_columns, text = docs.columns, docs.columns.index("text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in small(batches):
            count, keys, signs, bands = [], [], [], []
            for found in shingle_sets(batch.column(text), words):
                count.append(len(found))
                if not len(found):
                    keys.append(None), signs.append(None), bands.append(None)
                    continue
                low = minima(found)
                keys.append(blake2b(found.tobytes(), digest_size=16).digest())
                signs.append(packed(low))
                bands.append(band_keys(low))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(count, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(signs, pa.list_(pa.int64())),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(range(row, row + batch.num_rows), pa.int64()),
                ],
                [*docs_columns, "n_shingles", "set_key", "signature", "bands", "row"],
            )
            row += batch.num_rows

    added = (
        "n_shingles bigint, set_key binary, signature array<bigint>, bands array<bigint>, row bigint"
    )
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(added).fields])
    return docs.mapInArrow(sign, schema)


def agreeing(a: str, b: str) -> Column:
    """How many of the 128 positions agree in two packed signatures."""
    words = LONGS // BITS
    total = F.lit(MINIMA)
    for k in range(words):
        differ = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        for plane in range(1, BITS):
            at = plane * words + k
            differ = differ.bitwiseOR(F.col(a)[at].bitwiseXOR(F.col(b)[at]))
        total = total - F.bit_count(differ)
    return total


def similarity(agree: Column) -> Column:
    """The estimate of Jaccard similarity with chance agreement taken out."""
    chance = 1 / 2**BITS
    return F.greatest(F.lit(0.0), (agree / F.lit(MINIMA) - chance) / (1 - chance))


def least_estimate(percent: int) -> float:
    """6.5 standard deviations below a true similarity of ``percent`` / 100."""
    chance = 1 / 2**BITS
    p = percent / 100 + (1 - percent / 100) * chance
    return max(0.0, (p - 6.5 * (p * (1 - p) / MINIMA) ** 0.5 - chance) / (1 - chance))


def _possible(percent: int) -> Column:
    """Set sizes and signatures allow a similarity of ``percent`` / 100."""
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return sizes & (similarity(agreeing("sign_a", "sign_b")) >= least_estimate(percent))


def _linked(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    spot = np.searchsorted(left, right)
    spot[spot == len(left)] = 0
    both = int((left[spot] == right).sum())
    return 100 * both >= percent * (len(left) + len(right) - both)


def _pairs(a: list[int], b: list[int]) -> list[pa.Array]:
    return [pa.array(a, pa.int64()), pa.array(b, pa.int64())]


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` with 100 * intersection >= percent * union, counted on full sets."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        held = 0

        def found(column: pa.Array, row: int, text: str) -> np.ndarray:
            nonlocal held
            if text not in known:
                one = next(shingle_sets(column.slice(row, 1), words))
                held += len(text) + one.nbytes
                if held > _CACHE:
                    known.clear()
                    held = len(text) + one.nbytes
                known[text] = one
            return known[text]

        for batch in small(batches):
            left, right = batch.column(2), batch.column(3)
            rows = [
                row
                for row, (a, b) in enumerate(zip(left.to_pylist(), right.to_pylist()))
                if _linked(found(left, row, a), found(right, row, b), percent)
            ]
            yield batch.select(["a", "b"]).take(pa.array(rows, pa.int64()))

    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(link, "a bigint, b bigint")


def confirmed_in_blocks(
    mixed: DataFrame, texts: DataFrame, words: int, percent: int, block: int
) -> DataFrame:
    """Links ``a, b`` between the components of a bucket, found block by block.

    ``mixed`` has band, node, root, n_shingles, signature, bands. A pair is looked at in
    the first band it shares only.
    """
    sizes = mixed.groupBy("band", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("band").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"),
        F.ceil(F.max("n") / block).cast("int").alias("mains"),
        F.greatest(F.lit(1), F.ceil((F.sum("n") - F.max("n")) / block)).cast("int").alias("others"),
    )
    # Written, as are other aggregates here that are joined back by their key: adaptive execution
    # splits a hot key among plain shuffles only.
    largest = written(largest, "largest")
    chunk = F.xxhash64("node")
    rows = mixed.join(largest, "band").withColumn("is_main", F.col("root") == F.col("main"))
    rows = rows.withColumn(
        "chunk", F.pmod(chunk, F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others")))
    )

    def place(kind: int, i: Column, j: Column, part: int) -> Column:
        long = [x.cast("bigint") for x in (F.lit(kind), i, j, F.lit(part))]
        return F.struct(*(x.alias(n) for x, n in zip(long, ("kind", "i", "j", "part"))))

    def below(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(
            F.array().cast("array<int>")
        )

    own = F.col("chunk")
    to_others = F.transform(below(F.col("others")), lambda i: place(0, i, own, 1))
    to_mains = F.transform(below(F.col("mains")), lambda j: place(0, own, j, 0))
    later = F.transform(below(F.col("others") - own), lambda j: place(1, own, own + j, 0))
    earlier = F.transform(below(own), lambda i: place(1, i, own, 1))
    places = F.when(F.col("is_main"), to_others).otherwise(F.concat(to_mains, later, earlier))
    rows = rows.withColumn("at", F.explode(places)).join(texts, "node")
    rows = rows.select(
        "band", "at.*", "node", "root", "n_shingles", "signature", "bands", "text"
    )

    def link(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        part = table["part"].to_numpy()
        ids, roots = table["node"].to_numpy(), table["root"].to_numpy()
        sizes = table["n_shingles"].to_numpy()
        planes = table["signature"].combine_chunks().flatten().to_numpy().reshape(-1, LONGS)
        bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        sets = list(shingle_sets(table["text"].combine_chunks(), words))
        right = np.flatnonzero(part == 1)
        if not len(right):
            right = np.flatnonzero(part == 0)
        band, least = table["band"][0].as_py(), least_estimate(percent)
        a, b = [], []
        for x in np.flatnonzero(part == 0):
            y = right[roots[right] != roots[x]]
            small, big = np.minimum(sizes[x], sizes[y]), np.maximum(sizes[x], sizes[y])
            y = y[small * 100 >= big * percent]
            same = bands[y] == bands[x]
            y = y[bands[x][same.argmax(axis=1)] == band]
            differ = planes[y] ^ planes[x]
            words_each = LONGS // BITS
            either = differ[:, :words_each].copy()
            for plane in range(1, BITS):
                either |= differ[:, plane * words_each : (plane + 1) * words_each]
            agree = 1 - np.bitwise_count(either.view(np.uint64)).sum(axis=1) / MINIMA
            chance = 1 / 2**BITS
            for z in y[(agree - chance) / (1 - chance) >= least]:
                if _linked(sets[x], sets[z], percent):
                    a.append(int(ids[x])), b.append(int(ids[z]))
        return pa.Table.from_arrays(_pairs(a, b), ["a", "b"])

    return rows.groupBy("band", "kind", "i", "j").applyInArrow(link, "a bigint, b bigint")


def _groups(
    signed: DataFrame,
    usable: DataFrame,
    words: int,
    percent: int,
    listed: int,
    block: int,
    by_id: bool,
) -> DataFrame:
    """``set_key, first, root`` per distinct set of ``usable`` rows: its smallest id and its component."""
    # A node is a distinct set, of which one row is compared. Copies only meet in this aggregate, which
    # map tasks begin, and in plain joins with what it wrote.
    classes = usable.groupBy("set_key").agg(
        F.min("doc_id").alias("first"), F.min("row").alias("row")
    )
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    own = signed.select("row", "n_shingles", "signature", "bands")
    own = own.join(classes.select("node", "row"), "row")
    own = written(own.select("node", "n_shingles", "signature", "bands"), "nodes")

    slots = own.select("node", F.explode("bands").alias("band"))
    buckets = slots.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    buckets = written(buckets.filter("least < most"), "buckets")
    members = written(slots.join(buckets, "band").select("band", "node", "least"), "members")
    pairs = members.filter("least < node").select(
        F.col("least").alias("a"), F.col("node").alias("b")
    )
    pairs = pairs.distinct().join(_side(own, "a"), "a").join(_side(own, "b"), "b")
    pairs = written(pairs.filter(_possible(percent)).select("a", "b").distinct(), "pairs")
    nodes = classes.select("node", "row")
    texts = _texts_of(signed, nodes, _ends(pairs))
    links = confirmed(pairs, texts, words, percent)
    if by_id:
        links = links.unionByName(_of_one_id(usable, classes))
    roots = written(components(links), "roots")

    # What the stars left open: buckets with members of more than one component.
    placed = members.join(roots.withColumnRenamed("id", "node"), "node", "left").select(
        "band", "node", F.coalesce("root", "node").alias("root")
    )
    placed = written(placed, "placed")
    mixed = placed.groupBy("band").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members")
    )
    mixed = written(mixed.filter("lo < hi").select("band", "members"), "open")
    mixed = written(placed.join(mixed, "band").join(own, "node"), "mixed")
    small, large = mixed.filter(F.col("members") <= listed), mixed.filter(F.col("members") > listed)
    left, right = (
        _side(small, name, F.col("band"), F.col("root").alias(f"root_{name}")) for name in "ab"
    )
    pairs = left.join(right, "band").filter((F.col("root_a") < F.col("root_b")) & _possible(percent))
    pairs = written(pairs.select("a", "b").distinct(), "possible")
    texts = _texts_of(signed, nodes, _ends(pairs).unionByName(large.select("node")))
    more = confirmed(pairs, texts, words, percent).unionByName(
        confirmed_in_blocks(large, texts, words, percent, block)
    )
    more = written(more, "more")
    if not more.isEmpty():
        links = roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more)
        roots = written(components(links), "roots")

    found = classes.join(roots.withColumnRenamed("id", "node"), "node", "left")
    return found.select("set_key", "first", F.coalesce("root", "node").alias("root"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def _texts_of(signed: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, text`` of the wanted nodes, which are few of all; written, as it is joined several times."""
    rows = written(nodes.join(wanted.distinct(), "node"), "wanted")
    some = with_keys(signed.select("row", "text"), rows, "row")
    return written(some.join(rows, "row").select("node", "text"), "texts")


def _of_one_id(usable: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the sets of rows that share an id."""
    placed = usable.select("doc_id", "set_key").join(classes.select("set_key", "node"), "set_key")
    placed = placed.select("doc_id", "node")
    shared = placed.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("most"))
    shared = written(shared.filter("a < most"), "shared")
    same = placed.join(shared, "doc_id").select("a", F.col("node").alias("b"))
    return same.filter("a < b").distinct()


def representatives(
    docs: DataFrame, words: int = 5, percent: int = 80, listed: int = 64, block: int = 512
) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, with all its columns.

    Groups are those of :func:`near_duplicates`, but rows count by their texts alone: rows without an id
    take part, and different texts that share an id stay. Of a group, exact repeats included, the row
    with the smallest doc_id stays, null last, and of several such any one. Rows without words all
    stay. An empty table gives an empty result. Needs folder ``spark.checkpoint.dir``; runs jobs.
    """
    signed = written(signatures(docs, words), "signatures")
    usable = signed.select("doc_id", "set_key", "row").filter("set_key is not null")
    groups = _groups(signed, usable, words, percent, listed, block, by_id=False)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = written(groups.select("set_key", "root"), "groups")
    best = usable.join(groups, "set_key").groupBy("root").agg(F.min(rank).alias("best"))
    chosen = written(best.select(F.col("best.row").alias("row")), "chosen")
    dropped = written(usable.select("row").join(chosen, "row", "left_anti"), "dropped")
    rows = signed.select(*docs.columns, "set_key", "row")
    # Whole rows are looked up by the fewer of both, so that most of them are never shuffled.
    if dropped.count() <= chosen.count():
        return without_keys(rows, dropped, "row").select(*docs.columns)
    wordless = rows.filter("set_key is null")
    kept = with_keys(rows, chosen, "row").join(chosen, "row", "left_semi")
    return kept.unionByName(wordless).select(*docs.columns)


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, listed: int = 64, block: int = 512
) -> DataFrame:
    """Return ``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Of open buckets with at most ``listed`` members the possible pairs are listed; larger
    ones are searched in blocks of about ``block`` members. Both give the same links.

    ``docs`` needs doc_id (bigint) and text; other columns are ignored. Documents are
    linked where 100 * intersection >= percent * union of their shingle sets, and component_id
    is the smallest doc_id reachable. Null or empty texts and texts of white space have an
    empty set and are linked with nothing. A row with a null doc_id can't be linked: its
    component is null and it is kept. Repeated doc_ids are one document, described by its
    rows together: each row keeps its own n_shingles. An empty table gives an empty result.
    Needs folder ``spark.checkpoint.dir``; runs jobs.
    """
    signed = written(signatures(docs.select("doc_id", "text"), words), "signatures")
    rows = signed.select("doc_id", "n_shingles", "set_key", "row")
    usable = rows.filter("doc_id is not null and set_key is not null")

    sets = _groups(signed, usable, words, percent, listed, block, by_id=True)

    # The smallest id of each component, and from there down to sets and rows.
    sets = written(sets, "sets")
    least = written(sets.groupBy("root").agg(F.min("first").alias("component")), "least")
    ids = written(sets.join(least, "root").select("set_key", "component"), "components")
    # An empty row has the component of its id's other rows, if it has any.
    empty = rows.filter("doc_id is not null and set_key is null")
    other = usable.join(empty.select("doc_id").distinct(), "doc_id", "left_semi")
    other = other.join(ids, "set_key").groupBy("doc_id").agg(F.min("component").alias("component"))
    columns = ["doc_id", "n_shingles", "component"]
    found = usable.join(ids, "set_key").select(*columns)
    found = found.unionByName(empty.join(written(other, "other"), "doc_id", "left").select(*columns))
    alone = rows.filter("doc_id is null").withColumn("component", F.lit(None).cast("bigint"))
    found = found.unionByName(alone.select(*columns))
    component = F.coalesce("component", "doc_id")
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def _side(own: DataFrame, name: str, *more: Column) -> DataFrame:
    return own.select(
        *more,
        F.col("node").alias(name),
        F.col("n_shingles").alias(f"n_{name}"),
        F.col("signature").alias(f"sign_{name}"),
    )

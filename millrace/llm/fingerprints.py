"""Document fingerprints by one-permutation MinHash, in SQL functions only.

The hashes of a text's word shingles are made once. The high bits of a hash name one of 128 bins,
and each bin keeps its least hash. An empty bin takes the value of the first filled one in a
probe order of its own, which depends on the bin alone (optimal densification), so two texts
fill an empty bin from one another's like independently of its neighbours. The fingerprint is the
low four bits of the bins' values. Where two fingerprints agree in a share m of the bins, chance
agreement of 1/16 is taken out: (m - 1/16) / (1 - 1/16).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_BITS = 7
BINS = 1 << BIN_BITS
BITS = 4
LONGS = BINS * BITS // 64
_PER_LONG = 64 // BITS


def shingle_hashes(text: Column, words: int) -> Column:
    """Hashes of all runs of ``words`` words; of the whole where it has fewer; none without words."""
    found = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    hashes = F.transform(found, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        last = F.size(h) - words
        each = F.transform(
            F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(h[i + k] for k in range(words)))
        )
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(
            F.when(last < 0, F.array(F.xxhash64(h))).otherwise(each)
        )

    return _let(hashes, runs)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def bins(hashes: Column) -> Column:
    """The least hash of every bin in order, null for empty bins; null without hashes."""

    # After all hashes of a bin comes a mark, the largest number of that bin: the least is a hash, or else the mark.
    low = (1 << 64 - BIN_BITS) - 1
    marks = _literal([(b - BINS * (2 * b >= BINS) << 64 - BIN_BITS) | low for b in range(BINS)])

    def fill(ordered: Column) -> Column:
        # Sorted as signed numbers, each bin's are together: those of the upper half of the bins, then the lower half's.
        later = F.filter(ordered, lambda h, i: h > F.get(ordered, i - 1).bitwiseOR(F.lit(low)))
        least = F.concat(F.slice(ordered, 1, 1), later)
        least = F.transform(least, lambda h: F.when(h.bitwiseAND(F.lit(low)) != low, h))
        half = BINS // 2
        return _let(least, lambda m: F.concat(F.slice(m, half + 1, half), F.slice(m, 1, half)))

    return F.when(F.size(hashes) > 0, _let(F.sort_array(F.concat(hashes, marks)), fill))


def densified(least: Column) -> Column:
    """Fill empty bins: bin b looks at (start + t * step) mod 128 for t = 0, 1, ... in turn.

    start and the odd step are hashes of b, so every bin visits all others. They are constants, and
    no turn after the first filled bin is looked at.
    """

    def constants(of: str) -> Column:
        return F.expr(f"array({', '.join(of.format(b=b) for b in range(BINS))})")

    starts = constants(f"int(pmod(xxhash64({{b}}, 'start'), {BINS}))")
    steps = constants(f"int(pmod(xxhash64({{b}}, 'step'), {BINS // 2})) * 2 + 1")

    def fill(own: Column, start: Column, step: Column) -> Column:
        def at(b: Column, t: int) -> Column:
            return F.get(own, (F.get(start, b) + F.get(step, b) * t).bitwiseAND(F.lit(BINS - 1)))

        return F.transform(own, lambda v, b: F.coalesce(v, *(at(b, t) for t in range(BINS))))

    return _let(starts, lambda start: _let(steps, lambda step: _let(least, lambda own: fill(own, start, step))))


def packed(values: str) -> Column:
    """The low four bits of a column of 128 values as eight longs; eight nulls for null."""

    def long(k: int) -> Column:
        parts = (
            F.shiftleft(F.col(values)[k * _PER_LONG + j].bitwiseAND(F.lit(15).cast("bigint")), BITS * j)
            for j in range(_PER_LONG)
        )
        return reduce(lambda a, b: a.bitwiseOR(b), parts)

    return F.array(*(long(k) for k in range(LONGS)))


def with_fingerprint(rows: DataFrame, text: str, name: str, words: int = 5) -> DataFrame:
    """``rows`` with eight longs for column ``text``; nulls for a null text or one without words."""
    # Values in a column of their own: packing reads them many times, and can be compiled.
    filled = rows.withColumn("_values", densified(bins(shingle_hashes(F.col(text), words))))
    return filled.withColumn(name, packed("_values")).drop("_values")


def as_text(packed_bits: Column) -> Column:
    """A fingerprint as 128 hexadecimal digits, empty for null."""
    digits = (F.lpad(F.hex(packed_bits[k]), 16, "0") for k in range(LONGS))
    return F.coalesce(F.lower(F.concat(*digits)), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, 0 to 1; 1 for two null fingerprints, 0 for one."""
    ones = F.lit(0x1111111111111111)

    def differing(x: Column) -> Column:
        return _let(
            x.bitwiseOR(F.shiftrightunsigned(x, 2)),
            lambda y: F.bit_count(y.bitwiseOR(F.shiftrightunsigned(y, 1)).bitwiseAND(ones)),
        )

    counts = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: differing(p["a"].bitwiseXOR(p["b"])))
    wrong = F.aggregate(counts, F.lit(0), lambda s, n: s + n)
    chance = 1 / 2**BITS
    share = ((F.lit(BINS) - wrong) / F.lit(float(BINS)) - chance) / (1 - chance)
    return (
        F.when(a.isNull() & b.isNull(), F.lit(1.0))
        .when(a.isNull() | b.isNull(), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), share))
    )


def _literal(numbers: list[int]) -> Column:
    """An array of whole numbers as one constant, however long."""
    if not numbers:
        return F.array().cast("array<bigint>")
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def with_next(docs: DataFrame, prepare: Callable[[DataFrame], DataFrame], pieces: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text) with the columns ``prepare`` adds from text, and for both next_<name>.

    The next row is that of the next smaller doc_id; the first one follows the last. Null ids come
    last, and rows of equal doc_id follow one another by text, nulls last. Rows are shuffled once,
    to one of ``pieces`` ranges of doc_id (4 times the shuffle partitions, unless given) between
    approximate quantiles, so ranges are even whatever the ids are. The first row of each range, which
    the range before needs as well, is read once more. Runs jobs.
    """
    spark = docs.sparkSession
    pieces = pieces or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_key"))
    quantiles = [k / pieces for k in range(1, pieces)] or [0.5]
    cuts = docs.agg(F.percentile_approx("_key", quantiles, 10 * pieces)).first()[0]
    falling = sorted(set(cuts or []), reverse=True)
    # How many limits are not below the key, counted in two steps of about the same size.
    step = max(1, int(len(falling) ** 0.5))
    key, coarse = F.col("_key"), _literal(falling[step - 1 :: step])
    skip = F.size(F.filter(coarse, lambda c: c >= key)) * step
    rest = F.slice(_literal(falling), skip + 1, F.lit(step))
    docs = docs.withColumn("_range", skip + F.size(F.filter(rest, lambda c: c >= key)))

    heads = docs.groupBy("_range").agg(F.max("_key")).orderBy("_range").collect()
    ranges, keys = [r for r, _ in heads], [k for _, k in heads]
    following = keys[1:] + keys[:1]
    first = spark.range(1).select(F.posexplode(_literal(following)).alias("_nth", "_key"))
    first = first.select(F.get(_literal(ranges), F.col("_nth")).cast("int").alias("_range"), "_key")
    first = docs.drop("_range").join(F.broadcast(first), "_key")  # one row per range
    first = first.groupBy("_range").agg(F.min("text").alias("text"))

    def ready(rows: DataFrame, own: bool) -> DataFrame:
        plain = [F.col(c) if own or c not in ("doc_id", "_key") else F.lit(None).cast("bigint").alias(c) for c in ("doc_id", "text", "_range", "_key")]
        return prepare(rows.select(*plain, F.lit(own).alias("_own")))

    both = ready(docs, True).unionByName(ready(first, False))
    order = [F.desc("_own"), F.desc("_key"), F.asc_nulls_last("text")]
    window = Window.partitionBy("_range").orderBy(*order)
    names = [c for c in both.columns if c not in ("doc_id", "_range", "_key", "_own")]
    nexts = [F.lead(c).over(window).alias(f"next_{c}") for c in names]
    return both.select("*", *nexts).filter("_own").drop("_range", "_key", "_own")


def edited_text() -> Column:
    """text with its last third, rounded down, replaced by as much of next_text's beginning."""
    text = F.coalesce("text", F.lit(""))
    third = F.floor(F.char_length(text) / 3).cast("int")
    head = F.substring(text, F.lit(1), F.char_length(text) - third)
    return F.concat(head, F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third))


def with_edits(docs: DataFrame, words: int = 5) -> DataFrame:
    """Fingerprint every text of ``docs`` (doc_id, text) and its edited text, and compare them.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next, one row per row. A null text is empty. A text without words has an empty
    fingerprint, which is like another empty one (1) and unlike all others (0). A text of fewer than
    ``words`` words is one shingle. Order of null and repeated ids: see :func:`with_next`. Other
    columns are ignored. An empty table gives an empty result.
    """
    rows = with_next(docs, lambda d: with_fingerprint(d, "text", "print", words))
    rows = with_fingerprint(rows.withColumn("edited", edited_text()), "edited", "edited_print", words)
    prints = F.col("print"), F.col("edited_print"), F.col("next_print")
    return rows.select(
        "doc_id",
        F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(prints[0]).alias("fingerprint"),
        as_text(prints[1]).alias("edited_fingerprint"),
        likeness(prints[0], prints[1]).alias("near_edited"),
        likeness(prints[0], prints[2]).alias("near_next"),
    )

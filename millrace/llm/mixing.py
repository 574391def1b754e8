"""Mixing sources to target weights by weighted fair queueing.

Every source is a flow whose weight is its target, and serves its documents in shuffled order,
up to three times over. A pass over a document finishes at the virtual time (words its source
has served until then) / target. All passes are queued with all their words, sorted by that time over
all sources, and the queue is cut where the running total reaches the budget, in what is being served
then. Sources reach their targets at virtual time 1, mostly amid a document. That one pass of a source is
queued in ``PACKETS`` parts, each with a finish time of its own, so what a source takes differs
from its target by about a part, and not by a whole document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import written
from .ranges import running_total

WEIGHTS = (5, 2, 1)
PASSES = 3
PACKETS = 64


def word_count(column: str):
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = PASSES) -> DataFrame:
    """Add ``place, before, weight, target`` to one row per source (source, source_size).

    Sources by code point, null last, get ``weights`` in turn; place counts them from 0 and
    before is the size of all earlier ones. Targets share the sum of all sizes by weight; none
    exceeds ``most`` times its source's size, and what that cuts off is shared again by weight
    among the others until none is above. That is min(most * size, level * weight) for the one
    level at which targets sum up; each round below raises the level by one aggregate.
    """
    ordered = sizes.withColumn("_last", F.col("source").isNull()).withColumn("_one", F.lit(1))
    ordered = running_total(ordered, ["_last", "source"], "_one", "_nth")
    ordered = running_total(ordered, ["_last", "source"], "source_size", "_until")
    turn = F.array(*(F.lit(w) for w in weights))
    ordered = written(
        ordered.select(
            "source",
            "source_size",
            (F.col("_nth") - 1).alias("place"),
            (F.col("_until") - F.col("source_size")).alias("before"),
            turn[((F.col("_nth") - 1) % len(weights)).cast("int")].alias("weight"),
        ),
        "sources",
    )
    cap = F.col("source_size") * most
    level, total = 0.0, ordered.agg(F.sum("source_size")).first()[0] or 0
    while total:
        full = cap <= F.col("weight") * level
        capped, left = ordered.agg(
            F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))
        ).first()
        raised = (total - capped) / left if left else level
        if raised <= level:
            break
        level = raised
    return ordered.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level)))


def mixed(docs: DataFrame, seed: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """Return ``doc_id, source, size, source_size, target, taken`` for every row of ``docs``.

    ``docs`` has doc_id, text and source; other columns are ignored, but those in ``keep`` follow
    in the result, and order the rows of one doc_id. size is the text's words, 0
    for a null or empty text, which is never taken. taken is how many words of the document the
    mix takes, repeats counted, at most three times its size, and is equal in every run; all
    together are the budget, the sum of all sizes. Null is a source of its own. Documents are shuffled by a
    hash of id and text, so rows without an id are too. Equal rows are served one after the other, each
    with its own taken. An empty table gives
    an empty result. Needs folder ``spark.checkpoint.dir``; runs jobs.
    """
    turn = F.xxhash64(F.lit(seed), "doc_id", "text")
    sized = docs.select(
        "doc_id", "source", word_count("text").alias("size"), turn.alias("turn"), *keep
    )
    # Numbers tell equal rows apart, so that any number of them can be cut into ranges.
    sized = written(sized.withColumn("row", F.monotonically_increasing_id()), "sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = written(targets(sums), "targets")

    # A source's words up to a document: the running total over all sources, less those before.
    placed = sized.withColumn("_last", F.col("source").isNull())
    placed = running_total(
        placed, ["_last", "source", "turn", "doc_id", *keep, "size", "row"], "size", "until"
    )
    placed = placed.join(
        shares.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    )
    placed = written(
        placed.withColumn("until", F.col("until") - F.col("before")).drop("_last", "_source"), "placed"
    )
    queue = placed.filter("size > 0")
    queue = queue.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1))))
    end = F.col("pass") * F.col("source_size") + F.col("until")
    at_one = (end > F.col("target")) & (end - F.col("size") < F.col("target"))
    parts = F.when(at_one, F.least(F.col("size"), F.lit(PACKETS))).otherwise(1).cast("int")
    queue = queue.withColumn("parts", parts).withColumn("end", end)
    queue = queue.withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    until, before = (F.floor(F.col("size") * k / F.col("parts")) for k in (F.col("part"), F.col("part") - 1))
    finish = (F.col("end") - F.col("size") + until) / F.col("target")
    queue = queue.select("row", "place", "turn", (until - before).alias("words"), finish.alias("finish"))
    queue = running_total(queue, ["finish", "place", "turn", "row"], "words", "served")
    budget = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    left = F.lit(budget) - F.col("served") + F.col("words")
    served = queue.filter(left > 0).groupBy("row").agg(F.sum(F.least("words", left)).alias("taken"))
    return placed.join(served, "row", "left").select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
        *keep,
    )

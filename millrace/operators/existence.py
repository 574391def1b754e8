"""Rows of one table that have, or lack, a matching key in another."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_match(
    left: DataFrame, right: DataFrame, on: dict[str, str], salts: int = 1
) -> DataFrame:
    """Rows of ``left`` with a match in ``right``; ``on`` maps left to right columns.

    A hot key in ``right`` is harmless. Where one key may hold a large share of ``left``,
    set ``salts`` to spread its rows over that many tasks; the result is the same.
    """
    return _match(left, right, on, "left_semi", salts)


def without_match(
    left: DataFrame, right: DataFrame, on: dict[str, str], salts: int = 1
) -> DataFrame:
    """Rows of ``left`` with no match in ``right``; rows with a null key are kept.

    Rows with a null key go around the join, so that they do not meet in one task.
    """
    complete = reduce(and_, (F.col(key).isNotNull() for key in on))
    unmatched = _match(left.filter(complete), right, on, "left_anti", salts)
    if not any(left.schema[key].nullable for key in on):
        return unmatched
    return unmatched.unionByName(left.filter(~complete))


def _match(
    left: DataFrame, right: DataFrame, on: dict[str, str], how: str, salts: int
) -> DataFrame:
    # Adaptive execution can't split the right side of a semi or anti join. distinct()
    # reduces a hot key there to one row per map task first, and its shuffle is the one
    # that the join needs anyway.
    keys = right.select(*on.values()).distinct()
    if salts == 1:
        return left.join(keys, [left[a] == keys[b] for a, b in on.items()], how)
    # Nor can it split the left side here, below an aggregate on the right. The salt is
    # a function of the row and its input partition, so a task that runs again repeats it.
    salt = F.pmod(F.xxhash64(*left.columns) + F.spark_partition_id(), F.lit(salts))
    salted = left.withColumn("_salt", salt.cast("int"))
    every = keys.withColumn("_each", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = [salted[a] == every[b] for a, b in on.items()] + [salted["_salt"] == every["_each"]]
    return salted.join(every, same, how).select(*left.columns)

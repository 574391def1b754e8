"""Subtotals over several groupings of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .measures import Measures, from_parts, from_rows


def subtotals(
    df: DataFrame,
    keys: list[str],
    measures: Measures,
    sets: str | list[list[str]] = "rollup",
) -> DataFrame:
    """Aggregate by ``rollup``, ``cube`` or a list of key lists.

    Column ``level`` is Spark's ``grouping_id``: one bit per key, first key highest,
    set where the key is summed over.

    A grouping-sets aggregate copies every input row once per set. Here it runs over
    the finest grouping only, whose size is the number of key combinations.

    Where the grand total is one of the sets, an empty table has that row too, as in SQL: a
    marker row without keys is added to the finest grouping and left out of all other levels.
    """
    finest = df.groupBy(*keys).agg(*from_rows(measures))
    has_total = isinstance(sets, str) or [] in sets
    if has_total:
        own = {"_own": ("count", F.lit(1))}
        finest = finest.withColumn("_own", F.lit(1).cast("bigint"))
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in finest.schema[:-1]]
        marker = df.sparkSession.range(1).select(*nothing, F.lit(0).cast("bigint").alias("_own"))
        finest, measures = finest.unionByName(marker), measures | own
    if sets == "rollup":
        grouped = finest.rollup(*keys)
    elif sets == "cube":
        grouped = finest.cube(*keys)
    else:
        grouped = finest.groupingSets([[F.col(key) for key in one] for one in sets], *keys)
    levels = grouped.agg(F.grouping_id().alias("level"), *from_parts(measures))
    if not has_total:
        return levels
    total = (1 << len(keys)) - 1
    return levels.filter((F.col("_own") > 0) | (F.col("level") == total)).drop("_own")

"""Connected components of a table of links, by rounds of stars that shrink to one per component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Return ``id, root`` for every id in ``links``; root is the smallest id reachable.

    Alternates large-star and small-star steps. Neighbours are never gathered in one row:
    a step takes the least neighbour of each id, an aggregate that map tasks begin, writes that and
    joins it back, so that adaptive execution can split an id with very many links. Each round's links
    are written to the shared folder, which cuts the lineage and survives lost executors.
    Links with a null end and loops are ignored. Runs jobs.
    """
    links = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    links = links.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    links = written(links.filter("lo < hi").distinct(), "links")
    seen = None
    while True:
        links = written(_small_star(_large_star(links)), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = links.select(F.col("hi").alias("id"), F.col("lo").alias("root"))
    return roots.unionByName(
        links.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct()
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Point every larger neighbour of an id at the id's least neighbour, or at itself."""
    both = links.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
        links.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = written(least.select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "least")
    moved = both.filter("v > u").join(least, F.col("u") == F.col("w"))
    return moved.select(F.col("m").alias("lo"), F.col("v").alias("hi")).filter("lo < hi").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Point an id and its smaller neighbours at the least of them."""
    least = written(links.groupBy(F.col("hi").alias("w")).agg(F.min("lo").alias("m")), "least")
    moved = links.join(least, F.col("hi") == F.col("w"))
    pairs = moved.select(F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi"))
    return pairs.filter("lo < hi").distinct()

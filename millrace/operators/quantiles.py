"""Exact quantiles by repeated counts over ranges that shrink."""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FloatType

from ..workspace import written

CELLS = 4096


def quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, str]) -> DataFrame:
    """One row per group with its row count ``n_rows`` and a column for each quantile in ``at``.

    ``at`` maps a new column to a share such as "0.9": the least value that at least that share of the
    group's values do not exceed (``percentile_disc``). ``value`` is a number; null values do not count
    and NaN is above all. A group without values is left out, so an empty table has no
    rows, nulls are a group of their own, and without ``keys`` all rows are one group.

    A group is never gathered. In a round, each quantile's range is cut into 4096 cells of equal
    width and rows are counted per cell, which map tasks begin; the cell that holds the rank is the
    next range, from its least value to its greatest. A quantile is found once these are equal. Whole
    numbers up to 10**7 take two or three rounds and doubles about five, each a scan of the keys and
    the value only. Writes the ranges to the shared folder and runs jobs.
    """
    data = df.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(value).alias("_v"))
    data = data.filter(F.col("_v").isNotNull())
    # Without keys a constant that Spark does not see as one, so that joins by it stay joins by key.
    own = [f"_{k}" for k in keys] or ["_all"]
    if not keys:
        data = data.withColumn("_all", F.pmod(F.hash("_v"), F.lit(1)))
    finite = F.when(_is_finite(F.col("_v")), F.col("_v"))
    totals = data.groupBy(*own).agg(
        F.count("*").alias("n_rows"), F.min(finite).alias("low"), F.max(finite).alias("high")
    )
    totals = written(totals.filter("n_rows > 0"), "totals")
    asked = F.array(*(_asked(name, Fraction(Decimal(share))) for name, share in at.items()))
    rank = F.expr("(n_rows * q.num + q.den - 1) div q.den")
    # The first range has no ends, as it holds what is not finite too.
    open_ = totals.withColumn("q", F.explode(asked)).select(
        *own, F.col("q.name").alias("name"), F.greatest(F.lit(1), rank).alias("rank"),
        "low", "high", F.lit(None).cast(data.schema["_v"].dataType).alias("first"),
        F.lit(None).cast(data.schema["_v"].dataType).alias("last"),
    )
    open_, found = written(open_, "open"), None
    while True:
        open_ = written(_narrowed(data, open_, own), "open")
        done = open_.filter("first = last").select(*own, "name", F.col("first").alias("value"))
        found = done if found is None else found.unionByName(done)
        open_ = open_.filter("first <> last")
        if open_.isEmpty():
            break
    columns = [F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in at]
    wide = found.groupBy(*own).agg(*columns)
    wide = wide.select(*(F.col(k).alias(f"{k}_") for k in own), *at)
    result = totals.join(wide, _same(own), "left")
    return result.select(*(F.col(f"_{k}").alias(k) for k in keys), "n_rows", *at)


def _asked(name: str, share: Fraction) -> Column:
    if not 0 <= share <= 1:
        raise ValueError(f"{name} is not a share: {share}")
    parts = {"num": share.numerator, "den": share.denominator}
    return F.struct(F.lit(name).alias("name"), *(F.lit(v).cast("bigint").alias(k) for k, v in parts.items()))


def _is_finite(v: Column) -> Column:
    return F.abs(v.cast("double")) < float("inf")  # NaN is above infinity


def _same(own: list[str]) -> Column:
    same = F.lit(True)
    for k in own:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return same


def _part(kind: DataType) -> Column:
    """How far along a value is from low (0) to high (1); keeps the order of values."""
    v, low, high = F.col("_v"), F.col("low"), F.col("high")
    if isinstance(kind, (FloatType, DoubleType)):
        v, low, high = (c.cast("double") for c in (v, low, high))
        wide = (high - low) == float("inf")
        scale = F.when(wide, 0.5).otherwise(1.0)
        return (v * scale - low * scale) / F.nullif(high * scale - low * scale, F.lit(0.0))
    if not isinstance(kind, DecimalType):
        v, low, high = (c.cast("decimal(20,0)") for c in (v, low, high))
    return (v - low).cast("double") / F.nullif((high - low).cast("double"), F.lit(0.0))


def _narrowed(data: DataFrame, open_: DataFrame, own: list[str]) -> DataFrame:
    """The cell with the rank, of each range in ``open_``, as the next range."""
    sides = open_.select(
        *(F.col(k).alias(f"{k}_") for k in own), "name", "low", "high", "first", "last"
    )
    inside = F.col("first").isNull() | F.col("_v").between(F.col("first"), F.col("last"))
    v = F.col("_v").cast("double")
    part = _part(data.schema["_v"].dataType)
    cell = F.least(F.lit(CELLS - 1), F.floor(F.coalesce(part, F.lit(0.0)) * CELLS))
    cell = F.when(_is_finite(v), cell).when(v < 0, -1).otherwise(F.when(F.isnan(v), CELLS + 1).otherwise(CELLS))
    rows = data.join(sides, _same(own) & inside).withColumn("cell", cell.cast("int"))
    finite = F.when(_is_finite(v), F.col("_v"))
    cells = rows.groupBy(*own, "name", "cell").agg(
        F.count("*").alias("n"), F.min("_v").alias("first"), F.max("_v").alias("last"),
        F.min(finite).alias("low"), F.max(finite).alias("high"),
    )
    in_order = Window.partitionBy(*own, "name").orderBy("cell")
    until = F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumn("until", until)
    ranks = open_.select(*(F.col(k).alias(f"{k}_") for k in own), F.col("name").alias("name_"), "rank")
    cells = cells.join(ranks, _same(own) & (F.col("name") == F.col("name_")))
    cells = cells.filter("until >= rank and until - n < rank")
    rank = F.col("rank") - F.col("until") + F.col("n")
    return cells.select(*own, "name", rank.alias("rank"), "low", "high", "first", "last")

"""Exact money arithmetic over columns that are stored as double.

A sum of doubles depends on the order of its terms, which a shuffle does not fix, so
amounts are summed as integers. The columns hold whole cents and whole percents, which
``rint`` recovers; casting a double to a decimal with places gives the same value, but
goes through its text form and takes several times as long.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

HUNDREDTHS, TEN_THOUSANDTHS = 2, 4


def _hundredths(column: str) -> Column:
    scaled = F.col(column) * 100
    wrong = F.raise_error(F.lit(f"{column} has a value finer than 0.01"))
    fits = F.abs(scaled - F.rint(scaled)) <= F.greatest(F.lit(1e-4), F.abs(scaled) * 1e-15)
    return F.when(fits | scaled.isNull(), F.rint(scaled).cast("bigint")).otherwise(wrong)


def hundredths(column: str) -> Column:
    """An amount in cents. The decimal type lets a sum grow to 28 digits."""
    return _hundredths(column).cast("decimal(18,0)")


def net_price(price: str = "l_extendedprice", discount: str = "l_discount") -> Column:
    """Price after discount, in ten-thousandths."""
    return (_hundredths(price) * (100 - _hundredths(discount))).cast("decimal(18,0)")


def amount(column: str, places: int = HUNDREDTHS) -> Column:
    """A sum of cents (``places`` 2) or ten-thousandths (4) as the double that is reported."""
    unit = F.lit(Decimal(1).scaleb(-places))
    return (F.col(column) * unit).cast("double").alias(column)

"""Union, intersection and difference of key sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import (
    except_all,
    except_distinct,
    intersect_all,
    intersect_distinct,
    union_distinct,
)
from ..sources import Tables
from . import sql
from .joins import in_year


def _nations(tables: Tables) -> tuple[DataFrame, DataFrame]:
    return (
        tables.customer.select(F.col("c_nationkey").alias("nationkey")),
        tables.supplier.select(F.col("s_nationkey").alias("nationkey")),
    )


def _buyers(tables: Tables, year: int) -> DataFrame:
    orders = tables.orders.filter(in_year("o_orderdate", year))
    return orders.select(F.col("o_custkey").alias("custkey"))


def nations_of_either(tables: Tables) -> DataFrame:
    """Nations with a customer or a supplier."""
    return union_distinct(*_nations(tables))


def buyers_in_both_years(tables: Tables) -> DataFrame:
    """Customers who ordered in 1996 and in 1997."""
    return intersect_distinct(_buyers(tables, 1996), _buyers(tables, 1997))


def buyers_lost_after_1996(tables: Tables) -> DataFrame:
    """Customers who ordered in 1996 and not in 1997."""
    return except_distinct(_buyers(tables, 1996), _buyers(tables, 1997))


def nations_matched(tables: Tables) -> DataFrame:
    """Nation keys of customers, each at most as often as among suppliers."""
    return intersect_all(*_nations(tables))


def nations_unmatched(tables: Tables) -> DataFrame:
    """Nation keys of customers, each less often by its suppliers."""
    return except_all(*_nations(tables))


REPORTS = {
    "nations_of_either": nations_of_either,
    "buyers_in_both_years": buyers_in_both_years,
    "buyers_lost_after_1996": buyers_lost_after_1996,
    "nations_matched": nations_matched,
    "nations_unmatched": nations_unmatched,
}


def _year(year: int) -> str:
    return f"select o_custkey as custkey from orders where {sql.in_year('o_orderdate', year)}"


_CUSTOMERS = "select c_nationkey as nationkey from customer"
_SUPPLIERS = "select s_nationkey as nationkey from supplier"

SQL = {
    "nations_of_either": f"{_CUSTOMERS} union {_SUPPLIERS}",
    "buyers_in_both_years": f"{_year(1996)} intersect {_year(1997)}",
    "buyers_lost_after_1996": f"{_year(1996)} except {_year(1997)}",
    "nations_matched": f"{_CUSTOMERS} intersect all {_SUPPLIERS}",
    "nations_unmatched": f"{_CUSTOMERS} except all {_SUPPLIERS}",
}

"""Rollup, cube and grouping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import TEN_THOUSANDTHS, amount, hundredths, net_price
from ..operators import count_rows, subtotals
from ..sources import Tables
from . import sql
from .joins import revenue_by_nation


def revenue_rollup(tables: Tables) -> DataFrame:
    """Revenue per nation and region of the customer, and overall."""
    by_nation = revenue_by_nation(tables, tables.orders)
    named = by_nation.join(tables.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        tables.region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    measures = {"revenue": ("sum", F.col("revenue")), "n_lines": ("sum", F.col("n_lines"))}
    return subtotals(named, ["r_name", "n_name"], measures, "rollup").withColumn(
        "revenue", amount("revenue", TEN_THOUSANDTHS)
    )


def orders_cube(tables: Tables) -> DataFrame:
    """Order counts and values by status, priority and year, in every combination."""
    orders = tables.orders.withColumn("o_year", F.year("o_orderdate"))
    measures = {
        "n_orders": count_rows(),
        "total": ("sum", hundredths("o_totalprice")),
        "smallest": ("min", F.col("o_totalprice")),
        "largest": ("max", F.col("o_totalprice")),
    }
    keys = ["o_orderstatus", "o_orderpriority", "o_year"]
    return subtotals(orders, keys, measures, "cube").withColumns(
        {"total": amount("total"), "o_year": F.col("o_year").cast("string")}
    )


def line_grouping_sets(tables: Tables) -> DataFrame:
    """Lines by flag and status, by ship year, and overall."""
    lines = tables.lineitem.withColumn("l_year", F.year("l_shipdate"))
    measures = {
        "quantity": ("sum", hundredths("l_quantity")),
        "revenue": ("sum", net_price()),
        "n_lines": count_rows(),
    }
    keys = ["l_returnflag", "l_linestatus", "l_year"]
    sets = [["l_returnflag", "l_linestatus"], ["l_year"], []]
    return subtotals(lines, keys, measures, sets).withColumns(
        {
            "quantity": amount("quantity"),
            "revenue": amount("revenue", TEN_THOUSANDTHS),
            "l_year": F.col("l_year").cast("string"),
        }
    )


REPORTS = {
    "revenue_rollup": revenue_rollup,
    "orders_cube": orders_cube,
    "line_grouping_sets": line_grouping_sets,
}

SQL = {
    "revenue_rollup": f"""
        select r_name, n_name, cast(grouping(r_name, n_name) as bigint) as level,
               cast(sum({sql.NET}) as double) as revenue, count(*) as n_lines
        from lineitem
        join orders on l_orderkey = o_orderkey
        join customer on o_custkey = c_custkey
        join nation on c_nationkey = n_nationkey
        join region on n_regionkey = r_regionkey
        group by rollup (r_name, n_name)
    """,
    "orders_cube": """
        select o_orderstatus, o_orderpriority, o_year,
               cast(grouping(o_orderstatus, o_orderpriority, o_year) as bigint) as level,
               count(*) as n_orders,
               cast(sum(cast(o_totalprice as decimal(12,2))) as double) as total,
               min(o_totalprice) as smallest, max(o_totalprice) as largest
        from (select *, cast(year(o_orderdate) as varchar) as o_year from orders)
        group by cube (o_orderstatus, o_orderpriority, o_year)
    """,
    "line_grouping_sets": f"""
        select l_returnflag, l_linestatus, l_year,
               cast(grouping(l_returnflag, l_linestatus, l_year) as bigint) as level,
               cast(sum(cast(l_quantity as decimal(12,2))) as double) as quantity,
               cast(sum({sql.NET}) as double) as revenue, count(*) as n_lines
        from (select *, cast(year(l_shipdate) as varchar) as l_year from lineitem)
        group by grouping sets ((l_returnflag, l_linestatus), (l_year), ())
    """,
}

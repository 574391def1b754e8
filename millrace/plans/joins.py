"""Star joins, and semi and anti joins.

No join carries a broadcast hint: Spark broadcasts a side only while its size is below
``spark.sql.autoBroadcastJoinThreshold`` and sort-merge joins it beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import TEN_THOUSANDTHS, amount, net_price
from ..operators import with_match, without_match
from ..sources import Tables
from . import sql


def in_year(column: str, year: int) -> Column:
    """A range on the raw column, which reaches the parquet scan; ``year(column)`` doesn't."""
    # A Python datetime would pass through the zones of both Python and the session.
    first, after = (F.expr(f"timestamp_ntz'{y}-01-01 00:00:00'") for y in (year, year + 1))
    return (F.col(column) >= first) & (F.col(column) < after)


def _summed(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum("revenue").alias("revenue"), F.sum("n_lines").alias("n_lines"))


def revenue_by_nation(tables: Tables, orders: DataFrame) -> DataFrame:
    """Revenue (in ten-thousandths) and line count per ``c_nationkey``, for these orders.

    Every table is shuffled once, on the key of the next join, and is summed per key in
    the map tasks before that. So lines move once and narrow, and neither an order with
    very many lines nor a customer with very many orders reaches a join as more than one row.
    """
    per_order = tables.lineitem.groupBy("l_orderkey").agg(
        F.sum(net_price()).alias("revenue"), F.count(F.lit(1)).alias("n_lines")
    )
    per_customer = _summed(
        per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), "o_custkey"
    )
    return _summed(
        per_customer.join(tables.customer, F.col("o_custkey") == F.col("c_custkey")), "c_nationkey"
    )


def nation_revenue(tables: Tables) -> DataFrame:
    """Revenue and line count of 1997 per nation of the customer."""
    by_nation = revenue_by_nation(tables, tables.orders.filter(in_year("o_orderdate", 1997)))
    return by_nation.join(tables.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "n_name", amount("revenue", TEN_THOUSANDTHS), "n_lines"
    )


def local_supplier_revenue(tables: Tables) -> DataFrame:
    """Revenue of 1997 per nation from lines whose customer and supplier share it."""
    # Orders meet customers before lines do, so that lines are shuffled once, by order.
    # One row per nation and supplier is left before suppliers are joined.
    orders = (
        tables.orders.filter(in_year("o_orderdate", 1997))
        .join(tables.customer, F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "c_nationkey")
    )
    by_supplier = (
        tables.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("c_nationkey", "l_suppkey")
        .agg(F.sum(net_price()).alias("revenue"))
    )
    local = (F.col("l_suppkey") == F.col("s_suppkey")) & (
        F.col("c_nationkey") == F.col("s_nationkey")
    )
    return (
        by_supplier.join(tables.supplier, local)
        .groupBy("s_nationkey")
        .agg(F.sum("revenue").alias("revenue"))
        .join(tables.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("n_name", amount("revenue", TEN_THOUSANDTHS))
    )


def brand_revenue(tables: Tables) -> DataFrame:
    """Revenue, lines and parts sold per brand."""
    by_part = tables.lineitem.groupBy("l_partkey").agg(
        F.sum(net_price()).alias("revenue"), F.count(F.lit(1)).alias("n_lines")
    )
    return (
        by_part.join(tables.part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("p_brand")
        .agg(
            F.sum("revenue").alias("revenue"),
            F.sum("n_lines").alias("n_lines"),
            F.count(F.lit(1)).alias("n_parts"),
        )
        .withColumn("revenue", amount("revenue", TEN_THOUSANDTHS))
    )


def orders_without_lines(tables: Tables) -> DataFrame:
    orders = tables.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return without_match(orders, tables.lineitem, {"o_orderkey": "l_orderkey"})


def customers_with_orders(tables: Tables) -> DataFrame:
    customers = tables.customer.select("c_custkey", "c_name", "c_mktsegment")
    return with_match(customers, tables.orders, {"c_custkey": "o_custkey"})


def customers_idle_in_1997(tables: Tables) -> DataFrame:
    customers = tables.customer.select("c_custkey", "c_name", "c_mktsegment")
    orders = tables.orders.filter(in_year("o_orderdate", 1997))
    return without_match(customers, orders, {"c_custkey": "o_custkey"})


REPORTS = {
    "nation_revenue": nation_revenue,
    "local_supplier_revenue": local_supplier_revenue,
    "brand_revenue": brand_revenue,
    "orders_without_lines": orders_without_lines,
    "customers_with_orders": customers_with_orders,
    "customers_idle_in_1997": customers_idle_in_1997,
}

_IN_1997 = sql.in_year("o_orderdate", 1997)

SQL = {
    "nation_revenue": f"""
        select n_name, cast(sum({sql.NET}) as double) as revenue, count(*) as n_lines
        from lineitem
        join orders on l_orderkey = o_orderkey
        join customer on o_custkey = c_custkey
        join nation on c_nationkey = n_nationkey
        where {_IN_1997}
        group by n_nationkey, n_name
    """,
    "local_supplier_revenue": f"""
        select n_name, cast(sum({sql.NET}) as double) as revenue
        from lineitem
        join orders on l_orderkey = o_orderkey
        join customer on o_custkey = c_custkey
        join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey
        join nation on s_nationkey = n_nationkey
        where {_IN_1997}
        group by n_nationkey, n_name
    """,
    "brand_revenue": f"""
        select p_brand, cast(sum({sql.NET}) as double) as revenue, count(*) as n_lines,
               count(distinct p_partkey) as n_parts
        from lineitem join part on l_partkey = p_partkey
        group by p_brand
    """,
    "orders_without_lines": """
        select o_orderkey, o_custkey, o_totalprice, o_orderdate from orders
        where not exists (select 1 from lineitem where l_orderkey = o_orderkey)
    """,
    "customers_with_orders": """
        select c_custkey, c_name, c_mktsegment from customer
        where exists (select 1 from orders where o_custkey = c_custkey)
    """,
    "customers_idle_in_1997": f"""
        select c_custkey, c_name, c_mktsegment from customer
        where not exists (select 1 from orders where o_custkey = c_custkey and {_IN_1997})
    """,
}

"""The first k of every group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import TEN_THOUSANDTHS, amount, hundredths, net_price
from ..operators import top_k
from ..sources import Tables
from . import sql


def top_orders_per_customer(tables: Tables) -> DataFrame:
    """The three largest orders of each customer."""
    orders = tables.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return top_k(orders, 3, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])


def top_customers_per_nation(tables: Tables) -> DataFrame:
    """The five customers of each nation with the highest order value."""
    spent = tables.orders.groupBy("o_custkey").agg(F.sum(hundredths("o_totalprice")).alias("spent"))
    customers = spent.join(tables.customer, F.col("o_custkey") == F.col("c_custkey"))
    best = top_k(
        customers.select("c_nationkey", "c_custkey", "spent"),
        5,
        ["c_nationkey"],
        [F.desc("spent"), F.asc("c_custkey")],
    )
    return best.join(tables.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "n_name", "rank", "c_custkey", amount("spent")
    )


def top_parts_per_brand(tables: Tables) -> DataFrame:
    """The three parts of each brand with the highest revenue."""
    sold = tables.lineitem.groupBy("l_partkey").agg(F.sum(net_price()).alias("revenue"))
    parts = sold.join(tables.part, F.col("l_partkey") == F.col("p_partkey"))
    best = top_k(
        parts.select("p_brand", "p_partkey", "p_name", "revenue"),
        3,
        ["p_brand"],
        [F.desc("revenue"), F.asc("p_partkey")],
    )
    return best.withColumn("revenue", amount("revenue", TEN_THOUSANDTHS))


def first_event_per_user_and_type(tables: Tables) -> DataFrame:
    """The earliest event of each type of each user."""
    events = tables.events.select("user_id", "event_type", "ts", "event_id", "value")
    order = [F.asc("ts"), F.asc("event_id")]
    return top_k(events, 1, ["user_id", "event_type"], order).drop("rank")


REPORTS = {
    "top_orders_per_customer": top_orders_per_customer,
    "top_customers_per_nation": top_customers_per_nation,
    "top_parts_per_brand": top_parts_per_brand,
    "first_event_per_user_and_type": first_event_per_user_and_type,
}

SQL = {
    "top_orders_per_customer": """
        select o_custkey, o_orderkey, o_totalprice, cast(place as integer) as rank
        from (select *, row_number() over (
                  partition by o_custkey order by o_totalprice desc, o_orderkey) as place
              from orders)
        where place <= 3
    """,
    "top_customers_per_nation": """
        with spent as (
            select c_nationkey, c_custkey, sum(cast(o_totalprice as decimal(12,2))) as spent
            from orders join customer on o_custkey = c_custkey
            group by c_nationkey, c_custkey),
        ranked as (
            select *, row_number() over (
                partition by c_nationkey order by spent desc, c_custkey) as place
            from spent)
        select n_name, cast(place as integer) as rank, c_custkey, cast(spent as double) as spent
        from ranked join nation on c_nationkey = n_nationkey
        where place <= 5
    """,
    "top_parts_per_brand": f"""
        with sold as (
            select p_brand, p_partkey, p_name, sum({sql.NET}) as revenue
            from lineitem join part on l_partkey = p_partkey
            group by p_brand, p_partkey, p_name),
        ranked as (
            select *, row_number() over (
                partition by p_brand order by revenue desc, p_partkey) as place
            from sold)
        select p_brand, p_partkey, p_name, cast(revenue as double) as revenue,
               cast(place as integer) as rank
        from ranked where place <= 3
    """,
    "first_event_per_user_and_type": """
        select user_id, event_type, ts, event_id, value
        from (select *, row_number() over (
                  partition by user_id, event_type order by ts, event_id) as place
              from events)
        where place = 1
    """,
}

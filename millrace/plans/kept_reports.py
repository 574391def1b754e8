"""Reports kept up to date by changes instead of being run anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import TEN_THOUSANDTHS, amount, net_price
from ..operators import KeptSums, signed_sums
from ..sources import Tables
from ..workspace import run_folder
from . import joins

_REVENUE = ["revenue"]


def nation_change(tables: Tables, lines: DataFrame) -> DataFrame:
    """What signed ``lines`` add to revenue and line count of 1997 per nation of the customer."""
    per_order = signed_sums(lines, ["l_orderkey"], {"revenue": net_price()}, "sign")
    orders = tables.orders.filter(joins.in_year("o_orderdate", 1997)).select("o_orderkey", "o_custkey")
    rows = per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.groupBy("o_custkey").agg(F.sum("revenue").alias("revenue"), F.sum("n_rows").alias("n_rows"))
    rows = rows.join(tables.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_nationkey").agg(
        F.sum("revenue").cast("decimal(38,0)").alias("revenue"), F.sum("n_rows").alias("n_rows")
    )


def nation_revenue_kept(tables: Tables) -> DataFrame:
    """Revenue of 1997 per nation after three deliveries of lines.

    The first brings lines up to line number 3, the second the others and, by mistake, returned
    lines of the first once more, which the third takes back. Each is applied to the sums kept so far.
    """
    lines = tables.lineitem
    first = F.coalesce(F.col("l_linenumber") <= 3, F.lit(True))
    again = lines.filter(first & (F.col("l_returnflag") == "R"))
    deliveries = {
        "first": lines.filter(first).withColumn("sign", F.lit(1)),
        "second": lines.filter(~first).unionByName(again).withColumn("sign", F.lit(1)),
        "third": again.withColumn("sign", F.lit(-1)),
    }
    kept = KeptSums(tables.spark, run_folder(tables.spark, "kept"), ["c_nationkey"], _REVENUE)
    for name, delivery in deliveries.items():
        kept.apply(name, nation_change(tables, delivery))
    by_nation = kept.current()
    return by_nation.join(tables.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "n_name", amount("revenue", TEN_THOUSANDTHS), F.col("n_rows").alias("n_lines")
    )


REPORTS = {"nation_revenue_kept": nation_revenue_kept}

SQL = {"nation_revenue_kept": joins.SQL["nation_revenue"]}

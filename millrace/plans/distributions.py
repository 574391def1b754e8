"""Exact quantiles per group and over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import amount, hundredths
from ..operators import quantiles
from ..sources import Tables

SHARES = {"lowest": "0", "median": "0.5", "p90": "0.9", "p99": "0.99"}


def value_quantiles(tables: Tables) -> DataFrame:
    """Median and upper quantiles of the value per event type, in cents while they are sought."""
    events = tables.events.select("event_type", hundredths("value").alias("value"))
    found = quantiles(events, ["event_type"], "value", SHARES)
    return found.select("event_type", "n_rows", *(amount(name).alias(name) for name in SHARES))


def price_quantiles(tables: Tables) -> DataFrame:
    """The same of the price over all lines, as doubles."""
    lines = tables.lineitem.select("l_extendedprice")
    return quantiles(lines, [], "l_extendedprice", SHARES)


def user_medians(tables: Tables) -> DataFrame:
    """The median value of every user."""
    events = tables.events.select("user_id", F.col("value").alias("value"))
    return quantiles(events, ["user_id"], "value", {"median": "0.5"})


REPORTS = {
    "value_quantiles": value_quantiles,
    "price_quantiles": price_quantiles,
    "user_medians": user_medians,
}


def _at(share: str, value: str) -> str:
    """The value at the first place that at least ``share`` of the rows do not exceed."""
    rank = f"greatest(1, cast(ceil(cast({share} as decimal(4,2)) * n_rows) as bigint))"
    return f"max(case when nth = {rank} then {value} end)"


def _sql(table: str, keys: str, value: str) -> str:
    part = f"partition by {keys}" if keys else ""
    first = f"{keys}, " if keys else ""
    columns = ", ".join(f"{_at(share, value)} as {name}" for name, share in SHARES.items())
    return f"""
        select {first}max(n_rows) as n_rows, {columns}
        from (
            select *, row_number() over ({part} order by {value}) as nth,
                count(*) over ({part}) as n_rows
            from {table} where {value} is not null
        ) {f"group by {keys}" if keys else "having count(*) > 0"}
    """


SQL = {
    "value_quantiles": _sql("events", "event_type", "value"),
    "price_quantiles": _sql("lineitem", "", "l_extendedprice"),
    "user_medians": """
        select user_id, count(*) as n_rows,
            max(case when nth = (n_rows + 1) // 2 then value end) as median
        from (
            select *, row_number() over (partition by user_id order by value) as nth,
                count(*) over (partition by user_id) as n_rows
            from events where value is not null
        ) group by user_id
    """,
}

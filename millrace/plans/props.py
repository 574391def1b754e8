"""Fields of the JSON properties of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import amount, hundredths, with_json_longs
from ..sources import Tables


def props_by_type(tables: Tables) -> DataFrame:
    """Count, sum and range of property ``k`` per event type."""
    events = with_json_longs(tables.events.select("event_type", "props"), "props", {"k": "k"})
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count("k").alias("n_with_k"),
        F.sum("k").alias("sum_k"),
        F.min("k").alias("min_k"),
        F.max("k").alias("max_k"),
    )


def value_by_prop(tables: Tables) -> DataFrame:
    """Events, purchases and total value per property ``k``."""
    events = tables.events.select("event_type", "value", "props")
    events = with_json_longs(events, "props", {"k": "k"})
    return events.groupBy("k").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("event_type") == "purchase").alias("n_purchases"),
        F.sum(hundredths("value")).alias("value"),
    ).withColumn("value", amount("value"))


REPORTS = {"props_by_type": props_by_type, "value_by_prop": value_by_prop}

_TEXT = "json_extract_string(props, '$.k')"
_K = f"case when regexp_full_match({_TEXT}, '-?[0-9]+') then try_cast({_TEXT} as bigint) end"

SQL = {
    "props_by_type": f"""
        select event_type, count(*) as n_events, count({_K}) as n_with_k,
               cast(sum({_K}) as bigint) as sum_k, min({_K}) as min_k, max({_K}) as max_k
        from events group by event_type
    """,
    "value_by_prop": f"""
        select {_K} as k, count(*) as n_events,
               count(*) filter (where event_type = 'purchase') as n_purchases,
               cast(sum(cast(value as decimal(12,2))) as double) as value
        from events group by {_K}
    """,
}

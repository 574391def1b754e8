"""Per-user gaps and running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import amount, hundredths, span_micros
from ..operators import running
from ..sources import Tables


def event_gaps(tables: Tables) -> DataFrame:
    """Each event with the time since the user's event before it."""
    events = tables.events.select("user_id", "event_id", "ts")
    with_previous = running(events, ["user_id"], ["ts", "event_id"], previous={"previous_ts": "ts"})
    gap = span_micros(F.col("ts") - F.col("previous_ts"))
    return with_previous.withColumn("gap_seconds", gap / 1_000_000)


def running_value(tables: Tables) -> DataFrame:
    """Each event with the user's event count and total value so far."""
    events = tables.events.select("user_id", "event_id", "ts", "value")
    totals = {
        "events_so_far": F.lit(1).cast("bigint"),
        "value_so_far": hundredths("value"),
    }
    return running(events, ["user_id"], ["ts", "event_id"], totals).withColumn(
        "value_so_far", amount("value_so_far")
    )


REPORTS = {"event_gaps": event_gaps, "running_value": running_value}

SQL = {
    "event_gaps": """
        select user_id, event_id, ts, previous_ts,
               cast(epoch_us(ts) - epoch_us(previous_ts) as double) / 1e6 as gap_seconds
        from (select *, lag(ts) over (partition by user_id order by ts, event_id) as previous_ts
              from events)
    """,
    "running_value": """
        select user_id, event_id, ts, value,
               count(*) over so_far as events_so_far,
               cast(sum(cast(value as decimal(12,2))) over so_far as double) as value_so_far
        from events
        window so_far as (partition by user_id order by ts, event_id
                          rows between unbounded preceding and current row)
    """,
}

"""Tumbling, sliding and session windows, and removal of repeated deliveries, in batch."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import amount, hundredths
from ..operators import Measures, count_rows, sessions, sliding, top_k, tumbling
from ..sources import Tables

HOUR = timedelta(hours=1)
QUARTER = timedelta(minutes=15)
GAP = timedelta(minutes=30)


def event_measures() -> Measures:
    return {"n_events": count_rows(), "value": ("sum", hundredths("value"))}


def as_double(df: DataFrame) -> DataFrame:
    return df.withColumn("value", amount("value"))


def hourly_events(tables: Tables) -> DataFrame:
    """Events and value per hour and type."""
    events = tables.events
    return as_double(tumbling(events, "ts", HOUR, ["event_type"], event_measures()))


def hourly_events_every_quarter(tables: Tables) -> DataFrame:
    """Events and value per type in hours that start every 15 minutes."""
    events = tables.events
    return as_double(sliding(events, "ts", HOUR, QUARTER, ["event_type"], event_measures()))


def user_sessions(tables: Tables) -> DataFrame:
    """Sessions per user, closed by half an hour without an event."""
    events = tables.events
    return as_double(sessions(events, "ts", GAP, ["user_id"], event_measures()))


def events_delivered_once(tables: Tables) -> DataFrame:
    """The first delivery of each event, out of a feed that delivers all of them twice."""
    events = tables.events
    feed = events.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    return top_k(feed, 1, ["event_id"], [F.asc("delivery")]).drop("rank")


REPORTS = {
    "hourly_events": hourly_events,
    "hourly_events_every_quarter": hourly_events_every_quarter,
    "user_sessions": user_sessions,
    "events_delivered_once": events_delivered_once,
}

_VALUE = "cast(sum(cast(value as decimal(12,2))) as double) as value"

SQL = {
    "hourly_events": f"""
        select date_trunc('hour', ts) as window_start,
               date_trunc('hour', ts) + interval 1 hour as window_end,
               event_type, count(*) as n_events, {_VALUE}
        from events group by all
    """,
    "hourly_events_every_quarter": f"""
        with covered as (
            select time_bucket(interval 15 minutes, ts) - i * interval 15 minutes as window_start,
                   event_type, value
            from events, range(0, 4) as quarters(i))
        select window_start, window_start + interval 1 hour as window_end, event_type,
               count(*) as n_events, {_VALUE}
        from covered group by all
    """,
    "user_sessions": f"""
        with marked as (
            select user_id, ts, event_id, value,
                   case when ts - lag(ts) over (partition by user_id order by ts, event_id)
                             > interval 30 minutes then 1 else 0 end as starts
            from events),
        numbered as (
            select *, sum(starts) over (partition by user_id order by ts, event_id
                                        rows between unbounded preceding and current row) as nth
            from marked)
        select user_id, min(ts) as session_start, max(ts) + interval 30 minutes as session_end,
               count(*) as n_events, {_VALUE}
        from numbered group by user_id, nth
    """,
    "events_delivered_once": """
        with feed as (
            select *, 1 as delivery from events
            union all
            select *, 2 as delivery from events),
        numbered as (
            select *, row_number() over (partition by event_id order by delivery) as nth from feed)
        select event_id, ts, user_id, event_type, value, props,
               cast(delivery as integer) as delivery
        from numbered where nth = 1
    """,
}

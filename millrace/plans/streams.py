"""The event jobs as streams over the whole event table.

Closed by a last event, an append-mode stream gives what its batch form gives, so each
is checked against the same SQL.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import from_instant
from ..sources import Tables
from ..streaming import (
    Side,
    deduplicated,
    event_chains,
    pairs_within,
    replay,
    session_windows,
    sliding_windows,
    tumbling_windows,
)
from . import event_windows, timed_joins
from .event_windows import GAP, HOUR, QUARTER, as_double, event_measures

DELAY = timedelta(hours=1)
CLOSE_AFTER = timedelta(hours=3)
DAY = timedelta(days=1)


def hourly_events_stream(tables: Tables) -> DataFrame:
    def build(stream: DataFrame) -> DataFrame:
        return tumbling_windows(stream, "ts", HOUR, ["event_type"], event_measures(), DELAY)

    path, open_for = tables.path("events"), DELAY + HOUR
    return as_double(replay(tables.spark, path, build, "hourly", CLOSE_AFTER, open_for=open_for))


def hourly_events_every_quarter_stream(tables: Tables) -> DataFrame:
    def build(stream: DataFrame) -> DataFrame:
        return sliding_windows(
            stream, "ts", HOUR, QUARTER, ["event_type"], event_measures(), DELAY
        )

    path, open_for = tables.path("events"), DELAY + HOUR
    return as_double(replay(tables.spark, path, build, "sliding", CLOSE_AFTER, open_for=open_for))


def user_sessions_stream(tables: Tables) -> DataFrame:
    def build(stream: DataFrame) -> DataFrame:
        return session_windows(stream, "ts", GAP, ["user_id"], event_measures(), DELAY)

    path, open_for = tables.path("events"), DELAY + GAP
    return as_double(replay(tables.spark, path, build, "sessions", CLOSE_AFTER, open_for=open_for))


def events_delivered_once_stream(tables: Tables) -> DataFrame:
    def build(stream: DataFrame) -> DataFrame:
        twice = stream.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
        once = deduplicated(twice, "ts", ["event_id"], DELAY)
        return once.drop("delivery").withColumn("ts", from_instant("ts"))

    return replay(tables.spark, tables.path("events"), build, "deduplicated")


def purchases_after_views_stream(tables: Tables) -> DataFrame:
    """Every view with each purchase of its user in the half hour from it, or with none."""

    def side(stream: DataFrame, kind: str) -> Side:
        names = {"id": "event_id", "user": "user_id"}
        columns = {f"{kind}_{name}": F.col(column) for name, column in names.items()}
        return Side(stream, "ts", DELAY, columns, f"{kind}_ts", F.col("event_type") == kind)

    def build(stream: DataFrame) -> DataFrame:
        view, purchase = side(stream, "view"), side(stream, "purchase")
        pairs = pairs_within(view, purchase, {"view_user": "purchase_user"}, GAP, outer=True)
        times = {name: from_instant(name) for name in ("view_ts", "purchase_ts")}
        return pairs.drop("purchase_user").withColumns(times)

    path, open_for = tables.path("events"), DELAY + GAP
    return replay(tables.spark, path, build, "pairs", CLOSE_AFTER, open_for=open_for)


def purchase_paths_stream(tables: Tables) -> DataFrame:
    """Every purchase that follows a click of its user, which follows a view."""

    def build(stream: DataFrame) -> DataFrame:
        found = event_chains(
            stream, "ts", "user_id", "event_type", "event_id", timed_joins.STEPS, DAY, DELAY
        )
        return found.select(
            "user_id",
            *(f"{step}_id" for step in timed_joins.STEPS),
            *(from_instant(F.timestamp_micros(f"{s}_at")).alias(f"{s}_ts") for s in timed_joins.STEPS),
        )

    return replay(tables.spark, tables.path("events"), build, "paths", CLOSE_AFTER, open_for=DELAY)


REPORTS = {
    "hourly_events_stream": hourly_events_stream,
    "hourly_events_every_quarter_stream": hourly_events_every_quarter_stream,
    "user_sessions_stream": user_sessions_stream,
    "events_delivered_once_stream": events_delivered_once_stream,
    "purchases_after_views_stream": purchases_after_views_stream,
    "purchase_paths_stream": purchase_paths_stream,
}

SQL = {f"{name}_stream": text for name, text in event_windows.SQL.items()}
# Which of two deliveries in one batch comes first is left open.
SQL["events_delivered_once_stream"] = f"""
    select event_id, ts, user_id, event_type, value, props
    from ({event_windows.SQL["events_delivered_once"]})
"""
SQL["purchases_after_views_stream"] = """
    select v.event_id as view_id, v.user_id as view_user, v.ts as view_ts,
        p.event_id as purchase_id, p.ts as purchase_ts
    from (select * from events where event_type = 'view') v
    left join (select * from events where event_type = 'purchase') p
        on p.user_id = v.user_id and p.ts >= v.ts and p.ts < v.ts + interval 30 minute
"""
SQL["purchase_paths_stream"] = timed_joins.SQL["purchase_paths"]

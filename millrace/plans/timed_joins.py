"""Events joined by time: inside spans, and with the event before or after."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import amount, hundredths
from ..operators import asof_join, count_rows, interval_join, sessions
from ..operators.measures import from_rows
from ..sources import Tables

GAP = timedelta(minutes=30)
SOON = timedelta(minutes=5)
DAY_MICROS = 24 * 3600 * 1_000_000
STEPS = ["view", "click", "purchase"]


def events_in_sessions(tables: Tables) -> DataFrame:
    """Every event of a user with the session that it belongs to."""
    events = tables.events.select("event_id", "user_id", "ts")
    spans = sessions(tables.events, "ts", GAP, ["user_id"], {"n_events": count_rows()})
    spans = spans.withColumnRenamed("user_id", "session_user")
    joined = interval_join(
        events, spans, "ts", "session_start", "session_end", {"user_id": "session_user"}
    )
    return joined.drop("session_user")


def events_after_clicks(tables: Tables) -> DataFrame:
    """For every click the events of all users in the five minutes from it, itself included."""
    events = tables.events
    clicks = events.filter("event_type = 'click'").select(
        F.col("event_id").alias("click_id"),
        F.col("ts").alias("clicked_at"),
        (F.col("ts") + F.lit(SOON)).alias("until"),
    )
    points = events.select("ts", "user_id", "value")
    pairs = interval_join(points, clicks, "ts", "clicked_at", "until")
    measures = {"n_events": count_rows(), "value": ("sum", hundredths("value"))}
    found = pairs.groupBy("click_id", "clicked_at").agg(
        *from_rows(measures), F.max("user_id").alias("highest_user")
    )
    return found.withColumn("value", amount("value"))


def _of_type(tables: Tables, kind: str, prefix: str) -> DataFrame:
    return tables.events.filter(F.col("event_type") == kind).select(
        F.col("event_id").alias(f"{prefix}_id"),
        F.col("user_id").alias(f"{prefix}_user"),
        F.col("ts").alias(f"{prefix}_ts"),
    )


def last_view_before_purchase(tables: Tables) -> DataFrame:
    """Every purchase with its user's latest view in the day before, if there is one."""
    found = asof_join(
        _of_type(tables, "purchase", "purchase"),
        _of_type(tables, "view", "view"),
        {"purchase_user": "view_user"},
        {"purchase_ts": "view_ts"},
        ties=["view_id"],
        tolerance=DAY_MICROS,
    )
    return found.drop("view_user")


def next_purchase_after_view(tables: Tables) -> DataFrame:
    """Every view with its user's earliest purchase strictly after it, however late."""
    found = asof_join(
        _of_type(tables, "view", "view"),
        _of_type(tables, "purchase", "purchase"),
        {"view_user": "purchase_user"},
        {"view_ts": "purchase_ts"},
        ties=["purchase_id"],
        forward=True,
        exact=False,
    )
    return found.drop("purchase_user")


def purchase_paths(tables: Tables) -> DataFrame:
    """Every purchase with its user's latest earlier click in less than a day, and that one's view.

    Purchases without such a click, or whose click has no such view, are left out.
    """
    view, click, purchase = (_of_type(tables, kind, kind) for kind in STEPS)
    clicks = asof_join(
        click, view, {"click_user": "view_user"}, {"click_ts": "view_ts"}, ["view_id"],
        tolerance=DAY_MICROS - 1, exact=False,
    )
    clicks = clicks.drop("view_user")
    found = asof_join(
        purchase, clicks, {"purchase_user": "click_user"}, {"purchase_ts": "click_ts"}, ["click_id"],
        tolerance=DAY_MICROS - 1, exact=False,
    )
    columns = [f"{step}_{part}" for part in ("id", "ts") for step in STEPS]
    found = found.filter("view_id is not null")
    return found.select(F.col("purchase_user").alias("user_id"), *columns)


REPORTS = {
    "events_in_sessions": events_in_sessions,
    "events_after_clicks": events_after_clicks,
    "last_view_before_purchase": last_view_before_purchase,
    "next_purchase_after_view": next_purchase_after_view,
    "purchase_paths": purchase_paths,
}

SQL = {
    "events_in_sessions": """
        with marked as (
            select *, case when ts - lag(ts) over w > interval 30 minute then 1 else 0 end as apart
            from events window w as (partition by user_id order by ts, event_id)
        ),
        numbered as (
            select *, sum(apart) over (partition by user_id order by ts, event_id
                rows between unbounded preceding and current row) as nth
            from marked
        ),
        spans as (
            select user_id, min(ts) as session_start,
                max(ts) + interval 30 minute as session_end, count(*) as n_events
            from numbered group by user_id, nth
        )
        select event_id, e.user_id, ts, session_start, session_end, n_events
        from events e join spans s
            on e.user_id = s.user_id and ts >= session_start and ts < session_end
    """,
    "events_after_clicks": """
        with clicks as (select event_id as click_id, ts as clicked_at from events where event_type = 'click')
        select click_id, clicked_at, count(*) as n_events,
            cast(sum(cast(value as decimal(12,2))) as double) as value,
            max(user_id) as highest_user
        from clicks join events on ts >= clicked_at and ts < clicked_at + interval 5 minute
        group by click_id, clicked_at
    """,
    "last_view_before_purchase": """
        select p.event_id as purchase_id, p.user_id as purchase_user, p.ts as purchase_ts,
            case when near then v.event_id end as view_id, case when near then v.ts end as view_ts
        from (select * from events where event_type = 'purchase') p left join lateral (
            select event_id, ts, p.ts - ts <= interval 1 day as near from events
            where event_type = 'view' and user_id = p.user_id and ts <= p.ts
            order by ts desc, event_id desc limit 1
        ) v on true
    """,
    "next_purchase_after_view": """
        select v.event_id as view_id, v.user_id as view_user, v.ts as view_ts,
            p.event_id as purchase_id, p.ts as purchase_ts
        from (select * from events where event_type = 'view') v left join lateral (
            select event_id, ts from events
            where event_type = 'purchase' and user_id = v.user_id and ts > v.ts
            order by ts, event_id desc limit 1
        ) p on true
    """,
    "purchase_paths": """
        select p.user_id, v.event_id as view_id, c.event_id as click_id, p.event_id as purchase_id,
            v.ts as view_ts, c.ts as click_ts, p.ts as purchase_ts
        from (select * from events where event_type = 'purchase') p join lateral (
            select event_id, ts, user_id from events
            where event_type = 'click' and user_id = p.user_id and ts < p.ts
            order by ts desc, event_id desc limit 1
        ) c on c.ts > p.ts - interval 1 day join lateral (
            select event_id, ts from events
            where event_type = 'view' and user_id = c.user_id and ts < c.ts
            order by ts desc, event_id desc limit 1
        ) v on v.ts > c.ts - interval 1 day
    """,
}
